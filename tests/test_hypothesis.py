"""Randomised checks of the distributed ordering primitives against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.operators import metrics, ranking

values = st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=60)


@settings(max_examples=6, deadline=None)
@given(vals=values, q=st.sampled_from([0.0, 0.1, 0.5, 0.75, 1.0]), rpb=st.sampled_from([1, 3, 1000]))
def test_exact_quantile_property(spark, vals, q, rpb):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = ranking.exact_quantile(df, "v", q, rows_per_bucket=rpb).first().quantile
    assert got == pytest.approx(float(np.quantile(np.array(vals, dtype=float), q)))


@settings(max_examples=6, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=60),
       rpb=st.sampled_from([1, 2, 1000]))
def test_auc_property(spark, pairs, rpb):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    df = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, s double")
    from pyspark.sql import functions as F
    cum = ranking.ordered_cumulative(df, "s", {"pos": F.col("y").cast("long"), "neg": (1 - F.col("y")).cast("long")},
                                     rows_per_bucket=rpb)
    got_pos = sum(r.pos for r in cum.collect())
    assert got_pos == len(pos)
    auc = metrics.roc_auc(df, "y", "s").first().auc
    if not pos or not neg:
        assert auc is None
    else:
        brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
        assert auc == pytest.approx(brute)


@settings(max_examples=4, deadline=None)
@given(n=st.integers(1, 80), k=st.integers(2, 5), seed=st.integers(0, 10))
def test_fold_sizes_property(spark, n, k, seed):
    from pyspark.sql import functions as F
    from hearth.operators import sampling
    df = spark.range(n).select("id", (F.col("id") % 3 == 0).alias("poor"))
    f = sampling.stratified_kfold(df, k=k, seed=seed)
    sizes = {}
    for r in f.collect():
        sizes.setdefault(r.poor, {}).setdefault(r.fold, 0)
        sizes[r.poor][r.fold] += 1
    for cls, per in sizes.items():
        counts = [per.get(i, 0) for i in range(k)]
        assert max(counts) - min(counts) <= 1
    assert f.count() == n
