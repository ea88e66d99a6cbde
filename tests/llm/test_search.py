"""Nearest neighbours against brute force: recall, order, exact scores, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from hearth.llm import ann
from hearth.llm.queries import op6_collision_counting_ann
from tests.conftest import SF_MID

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], float(s[i])) for i in order]
    return out


def results(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_order(spark):
    e = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in e], np.array([r.embedding for r in e], float)
    got = results(op6_collision_counting_ann(spark, SF_MID))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for rows in got.values():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and len(rows) == 20


def test_many_blocks_agree_with_one(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16)) * 3
    x = (centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 16)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)], SCHEMA)
    want = brute(list(range(600)), x.astype(float), range(0, 600, 50), 5)
    for block, query_block in ((8192, 512), (100, 4)):
        got = results(ann.search(df, F.col("vec_id") % 50 == 0, k=5, block=block, query_block=query_block))
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 5 * len(want)
        for q, rows in got.items():
            assert all(abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-12 for i, s in rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (20, [0.0, -1.0]), (40, None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA).withColumn("score", F.lit("clash"))
    got = results(ann.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 0.5), (20, 0.0)],
                   20: [(0, 0.0), (1, 0.0), (2, 0.0), (3, -0.5)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
