"""Class balancing and splitting.

Every draw is a function of ``md5(key || seed)``, never of row order or
partitioning, so the result is the same after a repartition, a retry or an
executor loss. Ranks come from :func:`hearth.operators.ranking.hash_rank` and
cuts from :func:`hearth.operators.ranking.hash_first` (two-level, exact), so no step runs a whole class in one task; no sample is
taken by ``limit`` (which would funnel rows through one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import hash_hex, hex_prefix_int
from hearth.operators.neighbors import k_nearest
from hearth.operators.ranking import hash_first, hash_rank, join_nullsafe, ordered_cumulative


def _class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class of a binary label (at most true, false and NULL: checked)."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).take(4)
    if len(rows) > 3:
        raise ValueError(f"{label!r} is not a binary label")
    return {r[label]: r["n"] for r in rows}


def downsample(df: DataFrame, label: str = "poor", seed: int = 144, minority=True,
               key: Sequence[str] = ("id",)) -> DataFrame:
    """R1 ``resample_data(how='down')``: all minority rows plus as many majority
    rows, without replacement: those with the smallest ``md5(key || seed)``."""
    counts = _class_counts(df, label)
    n_min = counts.get(minority, 0)
    maj = df.where(F.col(label) != F.lit(minority))
    mino = df.where(F.col(label) == F.lit(minority))
    picked = hash_first(maj, list(key), seed, lambda n: F.lit(n_min), out="__p").where("__p").drop("__p")
    return picked.unionByName(mino)


def upsample(df: DataFrame, label: str = "poor", seed: int = 144, minority=True,
             key: Sequence[str] = ("id",), draw_col: str = "_draw") -> DataFrame:
    """R2 ``resample_data(how='up')``: all majority rows plus as many minority
    rows drawn *with* replacement. Draw ``i`` (0..n_maj-1) takes the minority
    row of rank ``md5(i || seed) mod n_min + 1`` (the first 60 bits of the hash). ``_draw`` numbers the draws
    (NULL on majority rows) so repeated rows stay distinguishable.

    The draws are generated by ``spark.range`` in parallel and joined to the
    ranked minority on the rank; draws spread evenly over ranks, so the join
    is not skewed, and a small minority side is broadcast by AQE.
    """
    counts = _class_counts(df, label)
    n_min = counts.get(minority, 0)
    n_maj = sum(v for k, v in counts.items() if k != minority and k is not None)
    maj = df.where(F.col(label) != F.lit(minority)).withColumn(draw_col, F.lit(None).cast("long"))
    if n_min == 0 or n_maj == 0:
        return maj
    mino = hash_rank(df.where(F.col(label) == F.lit(minority)), list(key), seed, rank_col="__r")
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, n_maj // 1_000_000)
    draws = spark.range(0, n_maj, numPartitions=parts).select(
        F.col("id").alias(draw_col),
        (F.pmod(hex_prefix_int(hash_hex([F.col("id")], seed), 15), F.lit(n_min)) + 1).alias("__r"))
    picked = draws.join(mino, "__r", "inner").drop("__r")
    return maj.unionByName(picked.select(*maj.columns))


def stratified_kfold(df: DataFrame, k: int = 3, label: str = "poor", seed: int = 2,
                     key: Sequence[str] = ("id",), fold_col: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """R3 ``StratifiedKFold(k, shuffle=True)``: within each class (and group
    ``by``, e.g. country), rows are ordered by ``md5(key || seed)`` and dealt
    round-robin: fold = (rank-1) % k. Fold sizes per class differ by at most one."""
    r = hash_rank(df, list(key), seed, by=[*by, label], rank_col="__r")
    return r.withColumn(fold_col, F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r")


def stratified_kfold_ordered(df: DataFrame, k: int = 3, label: str = "poor", key: str = "id",
                             fold_col: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """R4 ``StratifiedKFold`` without shuffling: contiguous blocks per class in
    key order (``ntile(k)`` semantics: the first ``n % k`` folds get one extra
    row). The key must be unique; the rank comes from the distributed running
    count over the key, not a single-task window."""
    g = [*by, label]
    cum = ordered_cumulative(df, key, {"c": F.lit(1).cast("long")}, by=g)
    ranks = cum.select(*g, key, (F.col("cum_c") - 1).alias("__r0"), F.col("tot_c").alias("__n"))
    q = F.floor(F.col("__n") / k)
    rem = F.col("__n") - q * k
    big = rem * (q + 1)
    fold = F.when(F.col("__r0") < big, F.floor(F.col("__r0") / (q + 1))) \
        .otherwise(rem + F.floor(F.try_divide(F.col("__r0") - big, q)))
    ranks = ranks.select(*g, key, fold.cast("int").alias(fold_col))
    return join_nullsafe(df, ranks, [*g, key])


def stratified_holdout(df: DataFrame, test_size: float = 0.05, label: str = "poor", seed: int = 0,
                       key: Sequence[str] = ("id",), split_col: str = "_holdout",
                       by: Sequence[str] = ()) -> DataFrame:
    """R5 ``train_test_split(stratify=y, test_size)``: per class (and group),
    the ``ceil(test_size * n_class)`` rows with the smallest hash are 'test'.
    The seed is required (ledger D19)."""
    r = hash_first(df, list(key), seed, lambda n: F.ceil(n * F.lit(test_size)), by=[*by, label], out="__p")
    return r.withColumn(split_col, F.when(F.col("__p"), "test").otherwise("train")).drop("__p")


def smote(df: DataFrame, features: Sequence[str], label: str = "poor", seed: int = 144, k: int = 5, minority=True,
          key: str = "id") -> DataFrame:
    """R6 SMOTE: all rows, and as many synthetic minority rows as the majority has more.

    Draw ``i`` takes the minority row of rank ``md5(i || seed) mod n_min + 1``, one of its ``k`` nearest
    minority rows (by ``md5(i || seed || 'neighbor')``), and a point on the line between them (by
    ``md5(i || seed || 'gap')``). Neighbours are exact (``neighbors.k_nearest``). Returns ``key, label``, the
    features as doubles and ``_draw`` (NULL on given rows; a synthetic row has its base row's key).
    A minority row without neighbours is repeated; rows with a NULL feature are kept and not drawn.
    """
    values = [F.col(c).cast("double").alias(c) for c in features]
    own = df.select(key, label, *values).withColumn("_draw", F.lit(None).cast("long"))
    rows = own.where(F.col(label) == F.lit(minority)).drop("_draw")
    for c in features:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    n_min, n_maj = rows.count(), df.where(F.col(label) != F.lit(minority)).count()
    more = n_maj - _class_counts(df, label).get(minority, 0)
    if more <= 0 or n_min == 0:
        return own
    near = k_nearest(rows, features, k, key)
    near = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))).alias("__near"))
    base = hash_rank(rows, [key], seed, rank_col="__r").join(near, key, "left")
    draws = df.sparkSession.range(0, more, numPartitions=max(df.sparkSession.sparkContext.defaultParallelism, more // 1_000_000))
    number = lambda what, digits: hex_prefix_int(hash_hex([F.col("_draw")], f"{seed}{what}"), digits)
    draws = draws.select(F.col("id").alias("_draw")).select(
        "_draw", (F.pmod(number("", 15), F.lit(n_min)) + 1).alias("__r"), number("neighbor", 15).alias("__pick"),
        (number("gap", 8) / F.lit(float(16**8))).alias("__gap"))
    size = F.coalesce(F.size("__near"), F.lit(0))
    pick = F.when(size > 0, F.get("__near", F.pmod(F.col("__pick"), F.greatest(size, F.lit(1))).cast("int"))["neighbor"])
    drawn = draws.join(base, "__r").withColumn("__to", F.coalesce(pick, F.col(key)))
    ends = rows.select(F.col(key).alias("__to"), *[F.col(c).alias(f"__to_{i}") for i, c in enumerate(features)])
    moved = [(F.col(c) + F.col("__gap") * (F.col(f"__to_{i}") - F.col(c))).alias(c) for i, c in enumerate(features)]
    return own.unionByName(drawn.join(ends, "__to").select(key, label, *moved, "_draw"))
