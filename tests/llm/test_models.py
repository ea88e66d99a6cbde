"""Toxicity and language identification: held-out accuracy, exact parts, edge cases."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from hearth.llm import common, langid, toxicity
from hearth.llm.queries import op3_language_id, op8_toxicity
from tests.conftest import SF_MID

SF_LARGE = "/root/testdata/sf0.1"
FRAME = "doc_id long, text string, score string, lang string"


def test_folds_hash(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456, None)], "doc_id long")
    for r in df.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert common.crc_of(r.doc_id) == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()))


def brute_shared(grams):
    """Pooled continuation distribution by the definition, in plain loops."""
    size, order = toxicity.SYMBOLS, toxicity.ORDER

    def digits(g, n):
        return tuple(g // size ** (n - 1 - i) % size for i in range(n))

    kinds = {order: {digits(int(g), order) for g in grams}}
    for k in range(order - 1, 0, -1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
    before = {k: {} for k in range(1, order)}
    for k in range(1, order):
        for g in kinds[k + 1]:
            before[k][g[1:]] = before[k].get(g[1:], 0) + 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / size
        rows = {x: n for x, n in before[k].items() if x[:-1] == g[:-1]}
        total = sum(rows.values())
        lower = p(g[1:]) if k > 1 else 1 / size
        if not total:
            return lower
        own = max(rows.get(g, 0) - toxicity.DISCOUNT, 0) / total
        return own + toxicity.DISCOUNT * len(rows) / total * lower

    return [p(digits(int(g), order)[1:]) for g in grams]


def test_kneser_ney_equals_the_definition():
    table = toxicity.symbol_table()
    tox = toxicity.grams_of("you loser you", table)
    ord_ = toxicity.grams_of("the loss of the use", table)
    grams = np.unique(np.concatenate([tox, ord_]))
    shared = toxicity.shared_backoff(grams)
    assert np.allclose(shared, brute_shared(grams))
    ct, co = (np.array([(x == g).sum() for g in grams]) for x in (tox, ord_))
    seen, rest = toxicity.evidence(grams, ct, co)
    for i, g in enumerate(grams):
        logs = []
        for c in (ct, co):
            own = grams // toxicity.SYMBOLS == g // toxicity.SYMBOLS
            total, types = c[own].sum(), (c[own] > 0).sum()
            lam = toxicity.DISCOUNT * types / total if total else 1.0
            logs.append(math.log((max(c[i] - toxicity.DISCOUNT, 0) / total if total else 0) + lam * shared[i]))
        assert abs(seen[i] - (logs[0] - logs[1])) < 1e-9


def test_counts_equal_plain(spark):
    rows = [("you loser", 1, 0), ("the use", 0, 0), ("the use", 0, 1), ("", 0, 0)]
    df = spark.createDataFrame(rows, "text string, toxic int, half int")
    table = toxicity.symbol_table()
    expected = {}
    for t, y, h in rows:
        for g in toxicity.grams_of(t, table):
            c = expected.setdefault((int(g), h), [0, 0])
            c[1 - y] += 1
    got = {(r.gram, r.half): [r.toxic, r.ordinary] for r in toxicity.count_grams(df).collect()}
    assert got == expected


def test_toxicity_edges(spark):
    toxic, plain = "you are a worthless clown today", "we walk along the quiet river every day"
    rows = [(i, f"{toxic} {i}") for i in range(30)] + [(100 + i, f"{plain} {i}") for i in range(60)]
    train = spark.createDataFrame([(t, int(i < 100)) for i, t in rows] + [(None, 0), ("x", None)], "text string, toxic int")
    model = toxicity.fit(spark, train)
    probe = [(1, f"{plain} with a worthless clown in it " + plain * 200), (2, plain * 3), (2, plain * 3), (None, ""),
             (3, None), (4, "中文 123 !!")]
    df = spark.createDataFrame([(*r, "clash", "x") for r in probe], FRAME)
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(df, model).collect()]
    assert len(got) == len(probe) and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)
    by = {i: (s, p) for i, s, p in got}
    assert by[1][1] == 1 and by[2][1] == 0 and by[3] == by[None]
    kept = toxicity.keep_ordinary(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 0 and kept.where("doc_id = 2").count() == 2


def test_toxicity_without_examples(spark):
    none = spark.createDataFrame([], "text string, toxic int")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert toxicity.toxicity(df, toxicity.fit(spark, none)).first().score < 0.01
    assert toxicity.toxicity(df.limit(0), toxicity.fit(spark, none)).count() == 0
    one_class = spark.createDataFrame([("a b", 0), ("c", 0)], "text string, toxic int")
    assert toxicity.toxicity(df, toxicity.fit(spark, one_class)).first().predicted == 0


def test_op8_held_out(spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = op8_toxicity(spark, SF_MID)
    assert got.count() == 1000
    j = got.join(labels, "doc_id")
    clean = j.where("held_out and toxic = 0")
    assert clean.where("predicted = 0").count() >= 0.97 * clean.count()
    assert j.where("toxic = 1 and predicted = 1").count() >= 0.6 * j.where("toxic = 1").count()


def test_op3_held_out(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, SF_MID).join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_langid_edges(spark):
    de, en = "der die das und nicht ein schönes haus", "the house is not a nice one and the dog"
    rows = [(f"{de} {i}", "de") for i in range(20)] + [(f"{en} {i}", "en") for i in range(20)] + [(None, "en"), ("x", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.langs) == {"de", "en"} and model.centres.shape[1] == langid.BUCKETS
    probe = [(1, de), (2, en), (2, en), (3, None), (4, ""), (5, "123 ²½ ..."), (None, "日本語"), (6, en * 5000)]
    df = spark.createDataFrame([(*r, "clash", "fr") for r in probe], FRAME)
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in langid.language_id(df, model).collect()]
    assert len(got) == len(probe) and all(0 <= s <= 1 for _, _, s, _ in got)
    by = {i: p for i, p, _, _ in got}
    assert by[1] == "de" and by[2] == by[6] == "en" and by[3] == by[4] == by[5] == "und" and by[None] in ("de", "en")
    for _, text in probe:  # the batch result is the nearest centroid by brute force
        if langid.has_letter(text):
            v = np.zeros(langid.BUCKETS)
            at, n = langid.gram_counts(text)
            v[at] = (1 + np.log(n)) * model.idf[at]
            assert model.identify_text(text)[0] == model.langs[int((model.centres @ v).argmax())]


def test_langid_without_training(spark):
    model = langid.fit(spark.createDataFrame([], "text string, lang string"))
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert langid.language_id(df, model).first().lang_pred == "und"
    assert langid.language_id(df.limit(0), model).count() == 0


def test_document_frequencies_equal_plain(spark):
    rows = ["the cat", "the dog", "", None]
    expected = np.zeros(langid.BUCKETS, int)
    for t in rows:
        expected[langid.gram_counts(t or "")[0]] += 1
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    assert (langid.document_frequencies(df) == expected).all()


def test_toxicity_finds_every_language(spark):
    """Held-out recall per language: expressions of any script, spread over a text."""
    got = op8_toxicity(spark, SF_LARGE).where("held_out")
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet").select("doc_id", "toxic")
    lang = spark.read.parquet(f"{SF_LARGE}/documents.parquet").select("doc_id", "lang")
    by = {r.lang: r for r in got.join(labels, "doc_id").join(lang, "doc_id").groupBy("lang").agg(
        F.count_if(F.expr("toxic = 1")).alias("toxic"), F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("found"),
        F.count_if(F.expr("toxic = 0")).alias("clean"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("wrong")).collect()}
    assert set(by) == {"en", "de", "fr", "es"}
    for r in by.values():
        assert r.found >= 0.75 * r.toxic and r.wrong <= 0.05 * r.clean, r


def test_words_of_any_script():
    assert toxicity.words_of("Ab-c \u00c9t\u00e9 E\u0301te\u0301") == ["ab", "c", "\u00e9t\u00e9", "\u00e9t\u00e9"]
    assert toxicity.words_of("\u043f\u0440\u0438\u0432\u0435\u0442, \u0645\u0631\u062d\u0628\u0627") == ["\u043f\u0440\u0438\u0432\u0435\u0442", "\u0645\u0631\u062d\u0628\u0627"]
    assert toxicity.words_of("\u4f60\u597d\u5417") == ["\u4f60\u597d\u5417", "\u597d\u5417", "\u5417"]


def test_words_of_a_batch_are_told_as_one_by_one(spark):
    """Texts looked up together have the features of each alone, whatever the portions."""
    import numpy as np
    import pandas as pd
    nodes = pd.DataFrame({"node": np.array([1], np.int64), "e0": [0.5]}), pd.DataFrame({"context": np.array([0], np.int64), "r0": [3.0]})
    words = toxicity.Words.of(spark, *nodes)
    rows = ["one two two", None, "", "zwei drei", "one " * 50, "Ünïcode wörds"]
    together = words.features_of(rows)
    assert together == [words.features_of([t])[0] for t in rows] and len(together) == len(rows)
    assert [len(p) for p in toxicity._portions(pd.Series(["x" * toxicity.PORTION, None, "y"]))] == [1, 2]
    spread = words.values({"one", "two"})
    top, total = words.features_of(["one two two"])[0]
    clear = [v - toxicity.CLEAR for v in (spread["one"], spread["two"], spread["two"]) if v > toxicity.CLEAR]
    assert top == max(0.0, spread["one"], spread["two"]) and abs(total - sum(clear) / 3 ** 0.5) < 1e-12


def test_samples_hold_with_one_text_in_a_third_of_the_rows(spark):
    """Copies of a text are drawn by their own ids: neither all nor none of them."""
    rows = [(i, "the same bad words" if i % 3 == 0 else f"text number {i} of many", int(i % 3 == 0), "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    drawn = []
    real = toxicity._scored
    toxicity._scored = lambda sample, *a: drawn.append(sample.groupBy("toxic").count().collect()) or real(sample, *a)
    try:
        toxicity.fit(spark, df, calibration_rows=600)
    finally:
        toxicity._scored = real
    n = {r.toxic: r["count"] for r in drawn[0]}
    assert 100 < n[1] < 300 and 300 < n[0] < 500
