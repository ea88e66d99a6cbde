"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random lines; each line is one
sorted array. A query opens a window around its own projection on every line;
a vector collides on a line when it lies in that window. Virtual rehashing
widens all windows step by step. What is counted are the entries outside the
first windows, less those that each wider window newly covers; a vector that
collides on more than ``COLLISIONS`` of the lines is verified by
its true inner product. A query ends when its k-th best verified vector lies
within the radius that the windows stand for, or when a set share of the block
and a set multiple of k vectors have been verified.

Largest inner product becomes smallest distance: data are scaled by the largest
length and given one more component that makes them unit vectors, queries are
scaled to length 1.

Scale: vectors lie in blocks of about ``BLOCK`` rows and queries in blocks of
about ``QUERY_BLOCK``, both by hash of the id; each pair of blocks is one group
of bounded size, and its k best per query are merged by rank. Every vector is
indexed and every query meets every block.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id or with another number of
components than most have (the smaller number, if tied). Rows with the same id
are one vector (the least). Fewer candidates than k give all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from hearth.llm.common import staged

PROJECTIONS = 64
COLLISIONS = 0.77  # share of the lines
FIRST_HALF_WIDTH, WIDEN, STEPS = 1.4, 1.1, 12
RADIUS = 1.36  # half a window's width in units of the radius it stands for
VERIFIED_SHARE, VERIFIED_PER_RESULT = 0.2, 12
BLOCK, QUERY_BLOCK = 8192, 512
K = 20

_FOUND = StructType([StructField("query_id", LongType(), False), StructField("vec_id", LongType(), False),
                     StructField("score", DoubleType(), False)])


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows that take part; ``v`` holds doubles."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    if sizes is not None:
        rows = rows.where(F.size("v") == sizes["d"])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


class Lines:
    """The sorted projections of one block of vectors."""

    def __init__(self, x: np.ndarray, longest: float, seed: int = 7):
        self.x = x
        unit = x / longest
        last = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", unit, unit)))
        self.lines = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, PROJECTIONS))
        p = unit @ self.lines[:-1] + last[:, None] * self.lines[-1]
        self.order = np.argsort(p, axis=0).T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, 0).T.copy()
        self.longest = longest

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the places and inner products of verified vectors, at least the
        ``k`` best of them as far as found."""
        n = len(self.x)
        size = np.linalg.norm(queries, axis=1)
        at = (queries / size[:, None]) @ self.lines[:-1]
        widths = [FIRST_HALF_WIDTH * WIDEN ** s for s in range(STEPS)]
        low = np.stack([[np.searchsorted(self.sorted[j], at[:, j] - h) for j in range(PROJECTIONS)] for h in widths])
        high = np.stack([[np.searchsorted(self.sorted[j], at[:, j] + h, "right") for j in range(PROJECTIONS)]
                         for h in widths])
        needed = int(np.ceil(COLLISIONS * PROJECTIONS))
        lines = list(self.order)
        out = []
        for q in range(len(queries)):
            lo, hi = low[:, :, q].tolist(), high[:, :, q].tolist()
            missed = np.zeros(n, np.int64)
            for s, h in enumerate(widths):
                if s == 0:
                    parts = [part for line, a, b in zip(lines, lo[0], hi[0], strict=True) for part in (line[:a], line[b:])]
                else:
                    ends = zip(lines, lo[s], lo[s - 1], hi[s - 1], hi[s], strict=True)
                    parts = [part for line, a, b, c, d in ends for part in (line[a:b], line[c:d])]
                change = np.bincount(np.concatenate(parts), minlength=n)
                missed = change if s == 0 else missed - change
                found = np.flatnonzero(missed <= PROJECTIONS - needed)
                if len(found) >= min(n, VERIFIED_PER_RESULT * k + VERIFIED_SHARE * n):
                    break
                if len(found) >= k:
                    score = self.x.take(found, 0) @ queries[q]
                    best = np.partition(score, len(found) - k)[len(found) - k]
                    # distance of unit vectors: |a - b|^2 = 2 - 2 ab
                    if 2 - 2 * best / (size[q] * self.longest) <= (h / RADIUS) ** 2:
                        break
            else:
                found = np.arange(n)  # the widest windows were not enough: verify the whole block
            out.append((found, self.x.take(found, 0) @ queries[q]))
        return out


def _block_search(longest: float, k: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64"})
        data = data.sort_values("vec_id")
        ids = data["vec_id"].to_numpy(np.int64)
        rows = []
        lines = Lines(np.stack(data["v"].to_list()), longest)
        found = lines.search(np.stack(queries["v"].to_list()), k + 1)
        for query_id, (at, score) in zip(queries["vec_id"], found, strict=True):
            other = ids[at] != query_id
            at, score = at[other], score[other]
            best = np.lexsort((ids[at], -score))[:k]
            rows.append(pd.DataFrame({"query_id": np.int64(query_id), "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(rows, ignore_index=True)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK,
           query_block: int = QUERY_BLOCK, vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of every vector for which ``is_query`` (a condition on
    ``vec_id``) holds, among all others: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    rows = staged(usable(vectors, vec), "vectors")
    queries = rows.where(is_query)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = rows.agg(F.count("*"), F.max(size)).first()
    blocks = max(1, -(-n // block))
    query_blocks = max(1, -(-queries.count() // query_block))

    def spread(frame: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return frame.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(count)).cast("int").alias(own),
                            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    data = spread(rows, "d", blocks, "q", query_blocks).groupBy("q", "d")
    asked = spread(queries, "q", query_blocks, "d", blocks).groupBy("q", "d")
    found = data.cogroup(asked).applyInPandas(_block_search(float(longest or 1.0), k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
