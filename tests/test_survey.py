"""The reference's file layout and recipes on a tiny set of twelve files."""

import csv
import random

import pytest

from hearth.__main__ import main
from hearth.plans.recipes import reference_recipes
from hearth.sources import io
from hearth.sources.io import SUBMISSION_SCHEMA, read_csv_table

OWN = {"A": ["TiwRslOh", "nEsgxvAq", "YFMZwKrU", "OMtioXZZ", "SlDKnCuu"], "B": ["wJthinfa", "ZvEApWrk", "FGWqGkmD"],
       "C": ["xFKmUXhu", "kLAQgdly", "mmoCpqWS", "DBjxSUvf", "LbGNqKmW"]}
WORDS = {"SlDKnCuu", "LbGNqKmW"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(6)
    out = tmp_path_factory.mktemp("survey")
    for c, names in OWN.items():
        for split, ids in (("train", range(60)), ("test", range(100, 120))):
            with open(io.survey_path(str(out), c, "hhold", split), "w", newline="") as f:
                w = csv.writer(f)
                w.writerow(["id", *names, *(["poor"] if split == "train" else []), "country"])
                for i in ids:
                    row = [rng.choice("xyz") if n in WORDS else (rng.choice(["", "NaN"]) if rng.random() < 0.1 else
                           round(rng.uniform(0.5, 4), 2)) for n in names]
                    w.writerow([i, *row, *([rng.random() < 0.4] if split == "train" else []), c])
            with open(io.survey_path(str(out), c, "indiv", split), "w", newline="") as f:
                w = csv.writer(f)
                w.writerow(["id", "iid", "country", "OdXpbPGJ", "wJthinfa"])
                for i in ids:
                    for k in range(rng.randint(1, 6)):
                        w.writerow([i, k, c, "", 1.5])
    return str(out)


def test_submit_with_the_reference_recipes(spark, folder, tmp_path):
    out = str(tmp_path / "sub")
    main(["submit", "--data", folder, "--out", out, "--recipes", "reference", "--trees", "2"])
    rows = read_csv_table(spark, out, SUBMISSION_SCHEMA).collect()
    assert sorted((r.country, r.id) for r in rows) == [(c, i) for c in "ABC" for i in range(100, 120)]
    assert all(0 <= r.poor <= 1 for r in rows)


def test_gaps_become_null(spark, folder):
    df = read_csv_table(spark, io.survey_path(folder, "A", "hhold", "train"))
    assert df.where("isnan(TiwRslOh)").count() == 0 and df.where("TiwRslOh is null").count() > 0


def test_read_all_countries(spark, folder):
    df = io.read_survey(spark, folder, "hhold", "train")
    assert df.count() == 180 and {"TiwRslOh", "wJthinfa", "DBjxSUvf"} <= set(df.columns)


def test_reference_models_are_uncut():
    assert [r.model["n_estimators"] for r in reference_recipes().values()] == [100, 400, 400]


def test_test_files_get_the_types_of_train(spark, tmp_path):
    """A column that is text in train stays text, however a test file's values look."""
    from hearth.plans.train import read_country
    rows = {"train": "id,code,x,poor,country\n1,a1,1.5,True,A\n2,7,NaN,False,A\n", "test": "id,code,x,country\n3,7,2,A\n4,8,odd,A\n"}
    for split, text in rows.items():
        with open(io.survey_path(str(tmp_path), "A", "hhold", split), "w") as f:
            f.write(text)
    df = read_country(spark, str(tmp_path), "A", "hhold")
    assert dict(df.dtypes)["code"] == "string" and dict(df.dtypes)["x"] == "double"
    assert sorted((r.id, r.code, r.x, r.poor, r._split) for r in df.collect()) == [
        (1, "a1", 1.5, True, "train"), (2, "7", None, False, "train"), (3, "7", 2.0, None, "test"), (4, "8", None, None, "test")]
