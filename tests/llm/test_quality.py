"""Weak supervision: statistics against a plain version, EM, and edge cases."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm import quality
from tests.conftest import SF_MID


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = list(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i, t in enumerate(triples):
        if triples.count(t) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


@given(st.text(alphabet=list("ab \n\t#é!.\x85 "), max_size=60))
@settings(max_examples=300, deadline=None)
def test_stats_equal_plain(text):
    assert quality.text_stats(text)[:5] == plain_stats(text)


def test_stats_of_nothing():
    assert quality.text_stats(None) == quality.text_stats("") == (0,) * len(quality.STATS)


def test_em_finds_rules_that_agree():
    rng = np.random.default_rng(3)
    rules = quality.RULES[:4]
    bad = rng.random(20_000) < 0.2
    counts = {}
    for y in bad:
        votes = [quality.BAD if rng.random() < (0.8 if y else 0.003) else quality.GOOD for _ in rules]
        key = sum(v * 3 ** j for j, v in enumerate(votes))
        counts[key] = counts.get(key, 0) + 1
    model = quality.expectation_maximisation(counts, rules)
    assert abs(model.good_share - 0.8) < 0.02
    assert all(abs(a - 0.8) < 0.05 for a in model.bad_if_bad)
    assert model.log_odds(0) < 0 < model.log_odds(sum(3 ** j for j in range(4)))


def test_posterior_column_equals_log_odds(spark):
    model = quality.expectation_maximisation({0: 5, 1: 20, 2186: 100, 3280: 900})
    keys = [0, 1, 5, 2186, 3280, 6560]
    df = spark.createDataFrame([(k,) for k in keys], "k int").select("k", model.posterior(F.col("k")).alias("p"))
    for r in df.collect():
        assert abs(r.p - 1 / (1 + np.exp(-model.log_odds(r.k)))) < 1e-12


def test_edge_rows(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "su"], 3)) for _ in range(300)]
    text = "".join(w + (". " if i % 9 == 8 else " ") for i, w in enumerate(words))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "x " * 500), (5, "word " * 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == by[3].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[4].base_failed and by[5].base_failed and by[1].kept and by[None].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(df).count() == 0 and quality.keep_good(df).count() == 0


def test_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    j = quality.judge(docs).where("not base_failed").join(labels, "doc_id")
    good = j.where("quality = 1")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert j.where("quality = 0 and not kept").count() >= 0.8 * j.where("quality = 0").count()
