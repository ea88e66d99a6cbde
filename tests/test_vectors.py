"""Hand-made vectors (FIXTURES.md part 3) for single operators."""

import math

import pytest
from pyspark.sql import functions as F

from hearth.operators import encode, metrics, ranking


def test_bins_right_closed(spark):
    vals = [0, 1, 3, 4, 13, 14, 20, 21, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, n long")
    out = {r.i: r.n for r in encode.bin_column(df, "n").collect()}
    assert [out[i] for i in range(len(vals))] == [None, "0-3", "0-3", "3-5", "10-13", "16+", "16+", None, None]


def test_constant_column_scaling(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert [r.x for r in encode.standardize(df, ["x"]).collect()] == [None, None]
    assert [r.x for r in encode.fill_zero(encode.standardize(df, ["x"]), ["x"]).collect()] == [0.0, 0.0]
    assert [r.x for r in encode.min_max_scale(df, ["x"]).collect()] == [0.0, 0.0]


def test_standardize_sample_std(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, x double")
    got = sorted(r.x for r in encode.standardize(df, ["x"]).collect())
    assert got == pytest.approx([-1.0, 0.0, 1.0])


def test_fill_mean_per_column_and_compat(spark):
    df = spark.createDataFrame([(1, 1.0, 100.0), (2, 3.0, None), (3, None, 300.0)], "id int, a double, b double")
    per = {r.id: (r.a, r.b) for r in encode.fill_mean(df, ["a", "b"]).collect()}
    assert per[2] == (3.0, 200.0) and per[3] == (2.0, 300.0)
    compat = {r.id: (r.a, r.b) for r in encode.fill_mean(df, ["a", "b"], compat=True).collect()}
    assert compat[2] == (3.0, 2.0) and compat[3] == (2.0, 300.0)


def test_fill_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 10.0), (4, 4.0)], "id int, a double")
    got = {r.id: r.a for r in encode.fill_median(df, ["a"]).collect()}
    assert got[2] == 4.0


def test_label_and_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, k string")
    le = {r.id: r.k for r in encode.label_encode(df, ["k"]).collect()}
    assert le == {1: 1, 2: 0, 3: None}
    oh = encode.one_hot(df, ["k"])
    assert oh.columns == ["id", "k_a", "k_b"]
    rows = {r.id: (r.k_a, r.k_b) for r in oh.collect()}
    assert rows == {1: (0, 1), 2: (1, 0), 3: (0, 0)}


def test_vocabulary_guard(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(encode.VocabularyTooLarge):
        encode.Vocabulary.fit(df, ["k"], max_categories=10)


def test_log_guard(spark):
    df = spark.createDataFrame([(1, math.e), (2, 1.0), (3, 0.0), (4, -1.0), (5, None)], "id int, x double")
    got = {r.id: r.x for r in encode.log_transform(df, "x").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0
    assert got[3] is None and got[4] is None and got[5] is None


def test_log_loss_terms(spark):
    df = spark.createDataFrame([(1, 1, 0.4), (2, 1, 0.1), (3, 0, 1.0), (4, 1, 0.0)], "id int, y int, p double")
    got = {r.id: r.penalty for r in metrics.penalty_rows(df, "y", "p").collect()}
    assert got[1] == pytest.approx(0.9163, abs=1e-4)
    assert got[2] == pytest.approx(2.3026, abs=1e-4)
    assert got[3] == pytest.approx(-math.log(1 - (1 - 1e-15)), rel=1e-9)
    assert got[4] == pytest.approx(-math.log(1e-15), rel=1e-6)


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, p double")
    r = metrics.classification_report(df, "y", "p").first()
    assert (r.f1, r.recall, r.precision) == (0.0, 0.0, 0.0)
    assert r.balanced_auc == 0.5


def test_confusion_matrix_full_grid(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, p double")
    cm = {(r.truth, r.predicted): r.n for r in
          metrics.confusion_matrix(df, "y", metrics.hard_label("p")).collect()}
    assert cm == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)


def test_weighted_and_unweighted_country_mean(spark):
    df = spark.createDataFrame([("A", 0.2), ("B", 0.4), ("C", 0.6)], "country string, log_loss double")
    w = metrics.weighted_country_mean(df).first()[0]
    assert w == pytest.approx((4041 * 0.2 + 1604 * 0.4 + 3187 * 0.6) / 8832)
    assert metrics.unweighted_country_mean(df).first()[0] == pytest.approx(0.4)


def test_post_rules(spark):
    df = spark.createDataFrame([(0.95,), (0.5,), (0.01,)], "p double")
    got = [(r.h, r.s) for r in df.select(metrics.post_rule("p", "hard").alias("h"),
                                          metrics.post_rule("p", "snap").alias("s")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.5), (0.0, 0.0)]


def test_exact_quantile_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=997), 2)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)], "g int, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.quantile for r in
               ranking.exact_quantile(df, "v", q, by=["g"], rows_per_bucket=40).collect()}
        for g in range(3):
            assert got[g] == pytest.approx(float(np.quantile(vals[np.arange(997) % 3 == g], q)))
    for rpb in (1, 7, 10_000):
        one = ranking.exact_quantile(df, "v", 0.5, rows_per_bucket=rpb).first().quantile
        assert one == pytest.approx(float(np.median(vals)))


def test_hash_rank_equals_flat_row_number(spark):
    from pyspark.sql import Window
    from hearth.functions.exprs import hash_hex
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("cls"))
    two = ranking.hash_rank(df, ["id"], 5, by=["cls"], rank_col="r", digits=2)
    four = ranking.hash_rank(df, ["id"], 5, by=["cls"], rank_col="r")
    assert two.exceptAll(four).count() == 0
    flat = df.withColumn("r", F.row_number().over(
        Window.partitionBy("cls").orderBy(hash_hex(["id"], 5), "id")))
    assert two.exceptAll(flat.select(*two.columns)).count() == 0
    assert two.count() == 3000


def test_ansi_safe_edges(spark):
    # one class absent: overlap/KS are NULL, not a division error
    from hearth.operators import profile, sampling
    df = spark.createDataFrame([(1, True, 1.0), (2, True, 2.0)], "id int, poor boolean, x double")
    r = profile.class_overlap(df, ["x"], "poor", n_bins=4).first()
    assert r.overlap is None and r.ks is None
    # a class with a constant value has no bandwidth: NULL density
    k = profile.class_kde(df.union(spark.createDataFrame([(3, False, 5.0)], df.schema)), "x", "poor", grid_size=4)
    assert k.where("poor = false").first().density is None
    # fewer rows than folds
    f = sampling.stratified_kfold_ordered(df, k=3)
    assert sorted(r.fold for r in f.collect()) == [0, 1]
    # frequency encoding with an empty fit set
    e = encode.frequency_encode(df, "poor", fit_on=F.col("id") > 5).collect()
    assert all(r.poor == 0.0 for r in e)


def test_rollup_report_has_total_row(spark):
    df = spark.createDataFrame([("A", 1, 0.9), ("A", 0, 0.2), ("B", 1, 0.3), ("B", 0, 0.6)],
                               "country string, y int, p double")
    rows = {r.country: r for r in metrics.classification_report(df, "y", "p", by=["country"], rollup=True).collect()}
    assert set(rows) == {"A", "B", None}
    assert rows[None].n == 4 and rows[None].tp == 1 and rows[None].fp == 1


def test_correlation_modes_agree(spark):
    from hearth.operators import profile
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    a = {(r.col_a, r.col_b): r.corr for r in profile.correlation(li, cols, "pairs").collect()}
    b = {(r.col_a, r.col_b): r.corr for r in profile.correlation(li, cols, "matrix").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_coverage_counts_childless(spark):
    from hearth.operators import joins
    hh = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, g string")
    ind = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "id long, iid long")
    rows = {r.g: r for r in joins.coverage(hh, ind, by=["g"]).collect()}
    assert rows["x"].n_households == 2 and rows["x"].n_without_indiv == 1
    assert rows["x"].any_covered and not rows["x"].all_covered and rows["y"].all_covered


def test_target_encoding_noise_is_seeded(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 2 == 0) for i in range(60)],
                               "id long, cat string, poor boolean")
    a = encode.smoothed_target_encode(df, "cat", min_samples_leaf=5, smoothing=2, noise_level=0.1, seed=7)
    b = encode.smoothed_target_encode(df.repartition(5), "cat", min_samples_leaf=5, smoothing=2,
                                      noise_level=0.1, seed=7)
    assert a.exceptAll(b.select(*a.columns)).count() == 0
    plain = {r.id: r.cat for r in encode.smoothed_target_encode(df, "cat", min_samples_leaf=5, smoothing=2).collect()}
    noisy = {r.id: r.cat for r in a.collect()}
    assert any(abs(noisy[k] - plain[k]) > 0 for k in plain)
    assert all(abs(noisy[k] - plain[k]) <= 0.1 * 3 ** 0.5 * plain[k] + 1e-12 for k in plain)


def test_stringify_edges(spark):
    from hearth.operators import schema
    df = spark.createDataFrame([(1, 3.0), (2, 2.5), (3, 1e20), (4, None)], "id int, x double")
    got = {r.id: r.x for r in schema.stringify_columns(df, ["x"]).collect()}
    assert got[1] == "3" and got[2] == "2.5" and got[4] == "nan"
    assert got[3] is not None and "E" in got[3].upper()


def test_caller_supplied_estimator(spark):
    from hearth.operators import profile
    df = spark.createDataFrame([("A", True, "x", 1.0), ("A", False, "x", 3.0), ("A", False, "y", 5.0)],
                               "country string, poor boolean, f string, v double")
    rows = {(r.poor, r.f): r for r in profile.class_category_share(df, "f", estimator=F.avg("v")).collect()}
    assert rows[(False, "x")].value == 3.0 and rows[(True, "x")].pct == pytest.approx(100 / 3)
