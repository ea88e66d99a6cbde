"""Collocations against DuckDB and plain counting; blocks and passes lose and repeat nothing."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearth.catalog.oracle import duck
from hearth.llm import phrases, sql
from hearth.llm.queries import op11_toivonen_phrases
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def counted(rows):
    """Every phrase of 1 to 3 words by language, and the number of words."""
    out, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    out[lang, " ".join(w[i:i + k])] += 1
    return out, total


def plain(rows, least, top=2000):
    f, total = counted(rows)
    cand = {key: a for key, a in f.items() if a >= least and " " in key[1]}
    out = {}
    for (lang, phrase), a in cand.items():
        w = phrase.split(" ")
        if any(n >= 0.5 * a and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} "
               for (other, q), n in cand.items() if other == lang):
            continue
        cuts = [(f[lang, " ".join(w[:j])], f[lang, " ".join(w[j:])]) for j in range(1, len(w))]
        score, j = min((10**6 * a * a // (left * right), j) for j, (left, right) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, *cuts[j]))
    return {(lang, i, p, -a, left, right, total[lang], -s) for lang, found in out.items()
            for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:top], 1)}


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["Ab", "b", "cé", "d'e", "ÀB", "f-g", "h i", "日本", "j\x1f", "k"]
    for i in range(n):
        text = "".join(rng.choices(words, [9, 8, 7, 5, 4, 3, 2, 2, 1, 1])[0] + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"])
                       for _ in range(rng.randint(0, 60)))
        yield i, text, rng.choice(["en", "fr", None]), 1, "clash"


def as_set(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"sample": 1}, {"sample": 1000}, {"block": 64}, {"most_bits": 6}])
def test_against_plain_counting(spark, options, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)  # crowded bit sets: most admitted phrases were not proposed
    rows = list(texts(80))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_set(phrases.collocations(df, min_count=4, **options)) == plain(rows, 4)


def test_longer_phrases_and_small_tops(spark):
    rows = list(texts(40, 5))
    df = spark.createDataFrame(rows, SCHEMA)
    f, _ = counted(rows)
    got = {(r.lang, r.phrase): r.n for r in phrases.frequent_phrases(df, min_count=3, max_words=4).where("k between 1 and 3").collect()}
    assert got == {key: n for key, n in f.items() if n >= 3}
    assert as_set(phrases.collocations(df, min_count=3, top=2)) == plain(rows, 3, 2)


def test_failures_widen_until_closed(spark, monkeypatch):
    """A sample that proposes nothing leaves everything to the border."""
    passes = []
    real = phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda *a: passes.append(a[4]) or real(*a))
    rows = [(7, "x y z", "en", 1, "c")] * 30 + [(8, "y z x y", "en", 1, "c")] * 5
    df = spark.createDataFrame(rows, SCHEMA).where(F.lit(True))
    got = as_set(phrases.collocations(df, sample=1_000_003))
    assert got == plain(rows, 10) and passes == [True, False, True, False, False]


def test_edges(spark):
    rows = [(1, None, "en", 1, "c"), (None, "", None, 1, "c"), (2, " \t. ,", "en", 1, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
    long = "a b, " * 200_000 + "A B" + " c" * 11  # a long text, cut into blocks; overlaps count
    rows = [(1, long, None, 1, "c"), (None, "a b", "und", 1, "c")]
    assert as_set(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == plain(rows, 10)


def test_registered_query(spark):
    want = {tuple(r) for r in duck(SF_SMALL).sql(sql.phrases_sql()).fetchall()}
    assert as_set(op11_toivonen_phrases(spark, SF_SMALL)) == want and want
