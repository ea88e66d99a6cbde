"""Exact k nearest neighbours within a table (R6), by pivots and distance bounds.

Rows with equal features become one vector. Every vector belongs to the cell of its
nearest pivot. From the cells' radii and the distances of their innermost
vectors follows how far the k-th neighbour of any vector of a cell can lie; a
vector is sent to exactly those cells that it could be a neighbour in (triangle
inequality), and distances are computed within cells. Whole cells out of reach
are never met; none that is in reach is left out.

Scale: there are about the square root of the vectors as pivots, at most
``MAX_PIVOTS``; pivots and ``k + 1`` distances a cell are all the driver holds. The
join on the cell emits pairs, of which a window keeps ``k + 1`` a vector before the shuffle;
a hot cell's pairs are split by AQE's skew join. Copies of one row meet as one vector that
carries its ``k + 1`` smallest keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from hearth.functions.exprs import hash_hex
from hearth.session import written

MAX_PIVOTS = 2048
#: Bounds are widened by this share, far above rounding errors.
SLACK = 1e-9


def _points(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(f"__f{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    step = max(1, 2_000_000 // max(1, pivots.size))
    parts = [np.sqrt(((x[i:i + step, None, :] - pivots[None]) ** 2).sum(2)) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(pivots)))


def vectors_of(df: DataFrame, features: Sequence[str], k: int, key: str) -> DataFrame:
    """Distinct feature vectors ``__f0, ..`` with their ``k + 1`` smallest keys (``ids``) and the smallest
    (``vid``). Rows with a NULL or NaN feature have no vector."""
    named = [f"__f{i}" for i in range(len(features))]
    rows = df.select(F.col(key).alias("__key"), *[(F.col(f).cast("double") + 0.0).alias(n) for f, n in zip(features, named)])
    for n in named:
        rows = rows.where(F.col(n).isNotNull() & ~F.isnan(n))
    few = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*named).orderBy("__key"))).where(F.col("__at") <= k + 1)
    return few.groupBy(*named).agg(F.array_sort(F.collect_list("__key")).alias("ids")).withColumn("vid", F.col("ids")[0])


def _cells(vectors: DataFrame, features: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """Each vector with its nearest pivot (``cell``) and the distance to it (``__d``)."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = StructType([*vectors.schema, StructField("cell", IntegerType()), StructField("__d", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d = _to_pivots(_points(part, features), held.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))],
                                                 names=schema.names)

    return vectors.mapInArrow(run, schema)


def _reach(stats: Sequence, inner: Sequence, pivots: np.ndarray, k: int) -> np.ndarray:
    """For each cell, the distance from its pivot beyond which no neighbour of its vectors lies."""
    apart = _to_pivots(pivots, pivots)
    radius = np.full(len(pivots), -np.inf)
    for r in stats:
        radius[r.cell] = r.radius
    cells, inside = np.array([r.cell for r in inner], int), np.array([r["__d"] for r in inner], float)
    if len(cells) <= k:
        return np.full(len(pivots), np.inf)
    # the k-th of the vectors near any pivot, as seen from each pivot (one of them may be the vector itself)
    kth = np.array([np.partition(row[cells] + inside, k)[k] for row in apart])
    return 2 * radius + kth  # from a vector at most radius + kth, from the pivot one radius more


def _sent(cells: DataFrame, features: Sequence[str], pivots: np.ndarray, reach: np.ndarray) -> DataFrame:
    """A row for each vector and each cell in whose reach it lies."""
    held = cells.sparkSession.sparkContext.broadcast((pivots, reach * (1 + SLACK) + SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, reach = held.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                row, cell = np.nonzero(_to_pivots(_points(part, features), pivots) <= reach)
                out = part.take(pa.array(row))
                yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(cell, pa.int32()))

    return cells.mapInArrow(run, cells.schema)


def _near(df: DataFrame, features: Sequence[str], k: int, key: str, n_pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """The vectors, and for each (``vid``) its ``k + 1`` nearest rows, itself included: ``near``, an array of
    (squared distance, key)."""
    vectors = written(vectors_of(df, features, k, key), "vectors")
    n = vectors.count()
    count = n_pivots or min(MAX_PIVOTS, max(1, int(n**0.5)))
    named = [f"__f{i}" for i in range(len(features))]
    chosen = vectors.select(*named, hash_hex(["vid"], "pivot").alias("__h")).orderBy("__h").limit(count).drop("__h").collect()
    pivots = np.array([tuple(r) for r in chosen], float).reshape(len(chosen), len(features))
    cells = written(_cells(vectors, features, pivots), "cells")
    inmost = Window.partitionBy("cell").orderBy("__d")
    inner = (cells.select("cell", "__d").withColumn("__at", F.row_number().over(inmost)).where(F.col("__at") <= k + 1)
             .select("cell", "__d").collect())
    reach = _reach(cells.groupBy("cell").agg(F.max("__d").alias("radius")).collect(), inner, pivots, k)
    own = cells.select("cell", "vid", *named)
    other = _sent(cells, features, pivots, reach).select("cell", F.col("ids").alias("__ids"), F.col("vid").alias("__vid"),
                                                         *[F.col(c).alias(f"{c}o") for c in named])
    d2 = None
    for c in named:
        gap = (F.col(c) - F.col(f"{c}o")) * (F.col(c) - F.col(f"{c}o"))
        d2 = gap if d2 is None else d2 + gap
    pairs = own.join(other, "cell").select("vid", "__vid", "__ids", d2.alias("__d2"))
    best = Window.partitionBy("vid").orderBy("__d2", "__vid")
    kept = pairs.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= k + 1)
    each = F.transform("__ids", lambda i: F.struct(F.col("__d2").alias("d2"), i.alias("id")))
    near = kept.groupBy("vid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("near"))
    return vectors, near


def k_nearest(df: DataFrame, features: Sequence[str], k: int = 5, key: str = "id", n_pivots: int | None = None) -> DataFrame:
    """Each row's ``k`` nearest other rows by squared Euclidean distance, ties to the smaller key (all others if
    there are fewer): ``key, rank, neighbor, d2``. Keys must be unique; rows with a NULL or NaN
    feature take no part."""
    vectors, near = _near(df, features, k, key, n_pivots)
    named = [f"__f{i}" for i in range(len(features))]
    rows = df.select(F.col(key), *[(F.col(f).cast("double") + 0.0).alias(n) for f, n in zip(features, named)])
    listed = rows.join(vectors.select("vid", *named), named).join(near, "vid")
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col(key)), 1, k)
    return listed.select(key, F.posexplode(others).alias("at", "e")).select(
        key, (F.col("at") + 1).alias("rank"), F.col("e.id").alias("neighbor"), F.col("e.d2").alias("d2"))
