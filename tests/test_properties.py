"""Properties of sampling, folds and encoders on the test tables."""

from pyspark.sql import functions as F

from hearth.operators import encode, joins, sampling
from hearth.sources.tables import households, individuals
from tests.conftest import SF_MID


def _train(spark):
    return households(spark, SF_MID).where(F.col("_split") == "train")


def test_folds_partition_rows_and_balance(spark):
    t = _train(spark)
    f = sampling.stratified_kfold(t, k=3, seed=2, by=["country"])
    assert f.count() == t.count()
    assert f.select("id").distinct().count() == t.count()
    sizes = f.groupBy("country", "poor", "fold").count().groupBy("country", "poor").agg(
        (F.max("count") - F.min("count")).alias("spread"))
    assert sizes.agg(F.max("spread")).first()[0] <= 1


def test_folds_independent_of_partitioning(spark):
    t = _train(spark)
    a = sampling.stratified_kfold(t, k=3, seed=2)
    b = sampling.stratified_kfold(t.repartition(7, "c_mktsegment"), k=3, seed=2)
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_ordered_folds_are_contiguous(spark):
    t = _train(spark)
    f = sampling.stratified_kfold_ordered(t, k=3)
    per = f.groupBy("poor", "fold").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    rows = sorted(per.collect(), key=lambda r: (r.poor, r.fold))
    for a, b in zip(rows, rows[1:]):
        if a.poor == b.poor:
            assert a.hi < b.lo and a.n >= b.n


def test_downsample_balances_without_repeats(spark):
    t = _train(spark)
    d = sampling.downsample(t, "poor", seed=144)
    c = {r.poor: r["count"] for r in d.groupBy("poor").count().collect()}
    assert c[True] == c[False]
    assert d.select("id").distinct().count() == d.count()
    assert d.join(t, "id", "left_anti").count() == 0


def test_upsample_balances(spark):
    t = _train(spark)
    u = sampling.upsample(t, "poor", seed=144)
    c = {r.poor: r["count"] for r in u.groupBy("poor").count().collect()}
    assert c[True] == c[False] == t.where(~F.col("poor")).count()
    assert u.where(F.col("poor")).select("_draw").distinct().count() == c[True]


def test_holdout_sizes(spark):
    t = _train(spark)
    h = sampling.stratified_holdout(t, test_size=0.05, seed=1)
    for r in t.groupBy("poor").count().collect():
        n_test = h.where((F.col("poor") == r.poor) & (F.col("_holdout") == "test")).count()
        assert n_test == -(-r["count"] * 5 // 100)


def test_one_hot_deterministic_under_repartition(spark):
    t = _train(spark).select("id", "c_mktsegment")
    a = encode.one_hot(t, ["c_mktsegment"])
    b = encode.one_hot(t.repartition(5), ["c_mktsegment"])
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0


def test_semi_plus_anti_is_all(spark):
    o = spark.read.parquet(f"{SF_MID}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select(F.col("l_orderkey").alias("id"))
    semi = o.join(li.distinct(), "id", "left_semi").count()
    anti = joins.households_without_indiv(o, li).count()
    assert semi + anti == o.count()
    assert anti > 0


def test_num_indiv_counts_rows(spark):
    h, i = households(spark, SF_MID), individuals(spark, SF_MID)
    n = joins.num_indiv(h, i)
    assert n.count() == h.count()
    assert n.agg(F.sum("num_indiv")).first()[0] == i.count()


def test_null_label_is_its_own_group(spark):
    h = households(spark, SF_MID)  # test rows have a NULL target
    f = sampling.stratified_kfold(h, k=3, seed=2)
    assert f.count() == h.count()
    o = sampling.stratified_kfold_ordered(h, k=3)
    assert o.count() == h.count()
    s = sampling.stratified_holdout(h, test_size=0.1, seed=1)
    assert s.count() == h.count()
