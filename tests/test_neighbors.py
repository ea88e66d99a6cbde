"""k nearest neighbours and SMOTE against brute force, pruning, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import neighbors, sampling

FEATURES = ["a", "b"]


def brute(rows, k):
    out = {}
    for i, *x in rows:
        d = sorted((sum((p - q) ** 2 for p, q in zip(x, y)), j) for j, *y in rows if j != i)
        out[i] = [(j, v) for v, j in d[:k]]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbor, r.d2))
        assert r["rank"] == len(got[r.id])
    return got


def clustered(n, seed=0, step=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-100, 100, (7, 2))
    x = np.round((centres[rng.integers(0, 7, n)] + rng.normal(0, 2, (n, 2))) / step) * step  # ties and equal rows
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]


@pytest.mark.parametrize("pivots", [1, 4, 40, None])
def test_neighbours_are_exact(spark, pivots):
    rows = clustered(260)
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(5)
    assert found(neighbors.k_nearest(df, FEATURES, 4, n_pivots=pivots)) == brute(rows, 4)


def test_pruned_cells_hold_no_neighbour(spark):
    """Far cells are not met, and every neighbour lies in a met cell."""
    rows = clustered(400, 2)
    df = spark.createDataFrame(rows, "id long, a double, b double")
    vectors = neighbors.vectors_of(df, FEATURES, 3, "id").persist()
    chosen = vectors.orderBy("vid").limit(25).select("__f0", "__f1").collect()
    pivots = np.array([tuple(r) for r in chosen])
    cells = neighbors._cells(vectors, FEATURES, pivots).persist()
    stats = cells.groupBy("cell").agg(F.max("__d").alias("radius")).collect()
    reach = neighbors._reach(stats, cells.select("cell", "__d").collect(), pivots, 3)
    sent = neighbors._sent(cells, FEATURES, pivots, reach).select("cell", "vid").collect()
    n = vectors.count()
    assert len(sent) < 0.5 * n * len(pivots)
    met = {(r.cell, r.vid) for r in sent}
    vid = {i: r.vid for r in vectors.collect() for i in r.ids}
    cell = {r.vid: r.cell for r in cells.collect()}
    for i, near in brute(rows, 3).items():
        for j, _ in near:
            if i in vid and j in vid:
                assert (cell[vid[i]], vid[j]) in met
    vectors.unpersist()
    cells.unpersist()


def test_equal_rows_and_few_rows(spark):
    rows = [(i, 1.0, 1.0) for i in range(90)] + [(200 + i, float(i), 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    assert found(neighbors.k_nearest(df, FEATURES, 5)) == brute(rows, 5)
    few = [(1, 0.0, 0.0), (2, 3.0, 4.0)]
    assert found(neighbors.k_nearest(spark.createDataFrame(few, "id long, a double, b double"), FEATURES, 5)) == brute(few, 5)
    one = spark.createDataFrame(few[:1], "id long, a double, b double")
    assert neighbors.k_nearest(one, FEATURES, 5).count() == 0 and neighbors.k_nearest(one.limit(0), FEATURES, 5).count() == 0


def test_missing_features_take_no_part(spark):
    rows = [(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 1.0, 0.0), (5, -0.0, 0.0)]
    got = found(neighbors.k_nearest(spark.createDataFrame(rows, "id long, a double, b double"), FEATURES, 2))
    assert got == {1: [(5, 0.0), (4, 1.0)], 4: [(1, 1.0), (5, 1.0)], 5: [(1, 0.0), (4, 1.0)]}


def smote(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, a double, b double, poor boolean, a2 string")
    return df, sampling.smote(df, FEATURES, **options).collect()


def test_smote_balances_along_lines_to_neighbours(spark):
    pos = clustered(40, 5)
    rows = [(*r, True, "x") for r in pos] + [(1000 + i, 0.0, float(i), False, "x") for i in range(130)]
    df, out = smote(spark, rows, k=3)
    made = [r for r in out if r._draw is not None]
    assert sorted(r._draw for r in made) == list(range(90)) and all(r.poor for r in made)
    assert sorted((r.id, r.a, r.b) for r in out if r._draw is None) == sorted(r[:3] for r in rows)
    near, at = brute(pos, 3), {i: (a, b) for i, a, b in pos}
    for r in made:
        a, b = at[r.id]
        assert any(abs((r.a - a) * (at[j][1] - b) - (r.b - b) * (at[j][0] - a)) < 1e-6
                   and min(a, at[j][0]) - 1e-9 <= r.a <= max(a, at[j][0]) + 1e-9 for j, _ in near[r.id])
    again = sampling.smote(df.repartition(7), FEATURES, k=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_smote_edges(spark):
    _, out = smote(spark, [(1, 2.0, 3.0, True, "x"), *((10 + i, 0.0, 0.0, False, "x") for i in range(4))])
    assert [(r.a, r.b) for r in out if r._draw is not None] == [(2.0, 3.0)] * 3  # one minority row: repeated
    _, out = smote(spark, [(i, 0.0, 0.0, False, "x") for i in range(3)])
    assert len(out) == 3
    _, out = smote(spark, [(i, 0.0, None, True, "x") for i in range(3)] + [(9, 0.0, 0.0, False, "x")])
    assert len(out) == 4
