"""Balance and plan checks that small results can't show."""

import re

import pytest
from pyspark.sql import functions as F

from hearth.catalog import REGISTRY
from hearth.functions.exprs import hash_hex, hex_prefix_int
from hearth.operators import encode, profile
from hearth.operators.ranking import ordered_cumulative, value_buckets
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("n_buckets", [353, 513, 600])
def test_buckets_are_even(spark, n_buckets):
    dist = spark.range(60_000).select(F.lit(0).alias("g"), (F.rand(3) * 1e6 + F.col("id") * 1e-9).alias("v"))
    dist = dist.persist()
    sizes = [r["count"] for r in value_buckets(dist, "v", ["g"], True, 1024, -(-60_000 // n_buckets))
             .groupBy("__bk").count().collect()]
    dist.unpersist()
    assert abs(len(sizes) - n_buckets) <= 3 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_buckets_grow_beyond_the_quantiles(spark):
    dist = spark.range(20_000).select(F.lit(0).alias("g"), (F.col("id") * 1.0).alias("v"))
    sizes = [r["count"] for r in value_buckets(dist, "v", ["g"], True, 16, 100).groupBy("__bk").count().collect()]
    assert len(sizes) >= 150
    cum = ordered_cumulative(dist, "v", {"n": F.lit(1).cast("long")}, max_buckets=16, rows_per_bucket=100)
    assert cum.where(F.col("cum_n") != F.col("v") + 1).count() == 0


def test_draws_reach_beyond_32_bits(spark):
    top = spark.range(100).select(hex_prefix_int(hash_hex([F.col("id")], 144), 15).alias("x")).agg(F.max("x")).first()[0]
    assert top > 2 ** 58


@pytest.fixture
def large_plans(spark):
    """Plan as for large inputs: no static broadcast, adaptive broadcast up to 64 MB."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _exchanges(df) -> list[str]:
    """The input columns of every shuffle of the plan that ran."""
    df.collect()
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    final = plan.split("== Initial Plan ==")[0]
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan if "Exchange" not in final else plan)


@pytest.mark.parametrize("name", ["r1_downsample", "r3_stratified_kfold", "r5_holdout"])
def test_ranked_rows_move_once(spark, large_plans, name):
    moved = {x for x in _exchanges(REGISTRY[name].fn(spark, SF_SMALL)) if "__h#" in x}
    assert len(moved) <= 1


def test_grouped_statistics_move_no_rows(spark, large_plans):
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").withColumn("id", F.col("c_custkey"))
    for df in (encode.standardize(c, ["c_acctbal"], by=["c_nationkey"]),
               encode.fill_mean(c, ["c_acctbal"], by=["c_nationkey"]),
               profile.zscore_outliers(c, ["c_acctbal"], by=["c_nationkey"]),
               encode.target_mean_encode(c, ["c_mktsegment"], label="c_acctbal"),
               encode.frequency_encode(c, "c_mktsegment")):
        assert not [x for x in _exchanges(df) if "c_custkey" in x]


def test_pair_modes_agree_on_gaps(spark):
    df = spark.range(500).select(*[F.when(F.rand(i) > 0.2, F.rand(i + 9) + F.col("id") * 1e-3 * i).alias(f"c{i}")
                                   for i in range(3)]).persist()
    a = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation(df, ["c0", "c1", "c2"]).collect()}
    b = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation(df, ["c0", "c1", "c2"], "matrix").collect()}
    df.unpersist()
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_matrix_correlation_reads_the_rows_once(spark):
    """One pass over the rows, with the session's settings as they were."""
    import pyarrow as pa
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, names=["u", "v", "w"])

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    rows = spark.range(0, 5000, 1, 4).select(*[F.rand(i).alias(c) for i, c in enumerate("uvw")])
    df = rows.mapInArrow(counted, "u double, v double, w double")
    assert profile.correlation(df, ["u", "v", "w"], "matrix").count() == 3
    assert seen.value == 5000 and spark.conf.get(key) == before


def test_matrix_correlation_of_odd_columns(spark):
    """Gaps, NaN, far offsets, columns that are constant, empty, infinite or partly absent from partitions."""
    import numpy as np
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        u, v = (float(x) for x in rng.random(2))
        rows.append((u, u + v + 1e9, None if i % 3 else v, float("nan") if i % 5 == 0 else u * v, 0.1, None,
                     float("inf") if i == 7 else v, v if i < 90 else None, u - v if i >= 300 else None))
    cols = list("abcdefghi")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(1).sortWithinPartitions("a")
    x = np.array(rows, dtype=float)
    for parts in (df, spark.createDataFrame(rows, df.schema).coalesce(3), spark.createDataFrame(rows, df.schema).repartition(7)):
        got = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation(parts, cols, "matrix").collect()}
        assert len(got) == 36
        for (a, b), found in got.items():
            p, q = x[:, cols.index(a)], x[:, cols.index(b)]
            both = ~np.isnan(p) & ~np.isnan(q)
            p, q = p[both], q[both]
            if not both.any() or {a, b} & {"e", "g"}:
                assert found is None, (a, b, found)
            else:
                p, q = p - p.mean(), q - q.mean()
                assert abs(found - (p @ q) / np.sqrt((p @ p) * (q @ q))) < 1e-7, (a, b)
    assert [r["corr"] for r in profile.correlation(df.where("a < 0"), ["a", "b"], "matrix").collect()] == [None]


def test_sparse_and_dense_grid_search_agree(spark):
    from hearth.plans import experiments
    from hearth.plans.features import build_features
    from hearth.plans.recipes import standin_recipes
    from hearth.sources.tables import households, individuals
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    out = []
    for sparse in (False, True):
        r = standin_recipes()["A"]
        r.sparse = sparse
        got = experiments.grid_search(build_features(r, h, i), {"kind": "logistic", "C": 1.0}, {"regParam": [0.1]})
        out.append(got.first().log_loss)
    assert abs(out[0] - out[1]) < 1e-3


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from hearth import session

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def test_median_shuffles_only_the_bracket(spark, monkeypatch):
    """Of 200,000 distinct values, the values that move lie within the sketch's bounds; the rank is exact."""
    import statistics
    from hearth.operators import ranking
    tables = []
    real = ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, name: tables.append(real(df, name)) or tables[-1])
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 200_003 * 1.5).alias("v"))
    got = {r.g: r.m for r in ranking.exact_quantile(df, "v", 0.5, by=["g"], out_col="m").collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.v)
    assert got == {g: statistics.median(v) for g, v in rows.items()}
    (counts,) = tables
    assert counts.count() < 0.002 * 200_000
    assert counts.agg(F.sum("n")).first()[0] == 200_000


def test_median_survives_a_bad_sketch(spark, monkeypatch):
    """Groups whose bracket misses the rank are solved from all their values."""
    from hearth.operators import ranking
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in range(40)] + [("c", None)], "g string, v double")
    real = F.percentile_approx
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda c, *a: F.array(F.lit(30.0), F.lit(31.0)) if c == "v" else real(c, *a))
    monkeypatch.setattr(ranking, "value_buckets", lambda dist, *a: dist.withColumn("__bk", F.lit(0)))
    got = {r.g: r.m for r in ranking.exact_quantile(df, "v", 0.5, by=["g"], out_col="m").collect()}
    assert got == {"a": 19.5, None: 19.5}
