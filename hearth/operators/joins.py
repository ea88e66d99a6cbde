"""Joins between households and individuals.

Scale notes: every join here first reduces the many-side to one row per key
(partial + final hash aggregate), so a household holding a third of all
individuals collapses map-side before the shuffle and the join itself is
one-to-one. Small per-key tables are left to AQE, which broadcasts them when
their materialised size is under the threshold and keeps a sort-merge join
otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators.ranking import attach_grouped, inline_rows


def num_indiv(hhold: DataFrame, indiv: DataFrame, key: str = "id", name: str = "num_indiv",
              fill: int | None = 0) -> DataFrame:
    """J1 + A1: number of individuals per household, attached by left join.

    Households without any individual get ``fill`` (0; None keeps NULL).
    Rows of ``indiv`` are counted, not distinct ``iid`` values.
    """
    counts = indiv.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = hhold.join(counts, key, "left")
    if fill is not None:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(fill).cast("long")))
    return out


def indiv_of(indiv: DataFrame, hhold: DataFrame, key: str = "id") -> DataFrame:
    """Individuals whose household is in ``hhold`` (left semi join)."""
    return indiv.join(hhold.select(key).distinct(), key, "left_semi")


def households_without_indiv(hhold: DataFrame, indiv: DataFrame, key: str = "id") -> DataFrame:
    """J3 (strict form): households with no individual (left anti join)."""
    return hhold.join(indiv.select(key).distinct(), key, "left_anti")


def coverage(hhold: DataFrame, indiv: DataFrame, key: str = "id", by: Sequence[str] = ("country",)) -> DataFrame:
    """Per group, households, households without individuals, and whether
    at least one (the reference's ``any``) / every household is covered."""
    keys = indiv.select(key).distinct().withColumn("__has", F.lit(True))
    j = hhold.join(keys, key, "left")
    has = F.coalesce(F.col("__has"), F.lit(False))
    return (j.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_households"),
                 F.sum(F.when(~has, 1).otherwise(0)).cast("long").alias("n_without_indiv"),
                 F.max(has).alias("any_covered"),
                 F.min(has).alias("all_covered")))


def map_lookup(df: DataFrame, col: str, mapping: DataFrame, key_col: str, value_col: str,
               out_col: str | None = None) -> DataFrame:
    """``df[col].map(mapping)``; values missing from the mapping become NULL.

    A NULL is in no category, so it becomes NULL too. ``mapping`` has one row
    per category: a mapping of at most ``MAX_INLINE_GROUPS`` rows is broadcast
    as literals, a larger one is joined (AQE splits skewed categories).
    """
    out_col = out_col or col
    m = mapping.select(F.col(key_col).alias("__k"), F.col(value_col).alias("__v")).where(F.col("__k").isNotNull())
    small = inline_rows(m)
    m = m if small is None else F.broadcast(small)
    j = df.join(m, df[col] == m["__k"], "left")
    j = j.drop("__k")
    if out_col == col:
        j = j.drop(col)
    return j.withColumnRenamed("__v", out_col)


def attach_stats(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach per-group statistics to every row.

    Grouped stats join on the group keys, a NULL group with itself (see
    ``attach_grouped``). Global stats are one row: it is
    collected (bounded: one value per statistic) and inlined as literals,
    which keeps the projection inside whole-stage codegen with no join.
    """
    if by:
        return attach_grouped(df, stats, by)
    rows = stats.take(2)
    if len(rows) != 1:
        raise ValueError("global stats must be exactly one row")
    row = rows[0].asDict()
    types = {f.name: f.dataType for f in stats.schema.fields}
    return df.select("*", *[F.lit(v).cast(types[k]).alias(k) for k, v in row.items()])
