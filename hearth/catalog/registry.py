"""Registry of the library's checkable queries (one per SURVEY section-2 row).

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL over the given tables, or None where the result is not
expressible in SQL (model fits). Doubles are rounded to 6 places on both
sides (``round(x, 6) + 0.0`` also turns -0.0 into 0.0).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    round_cols: tuple[str, ...]
    heavy: bool = False


REGISTRY: dict[str, Entry] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    sel = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            sel.append((F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            sel.append(F.col(f"`{f.name}`"))
    return df.select(*sel)


def rounded_sql(sql: str, cols: Sequence[str], digits: int = 6) -> str:
    if not cols:
        return sql.strip()
    rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql.strip()}\n) AS q"


def query(name: str, sql: str | None = None, round_cols: Sequence[str] = (), heavy: bool = False):
    """Register a query. ``round_cols`` lists the DOUBLE columns of the SQL side."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, run, None if sql is None else rounded_sql(sql, round_cols),
                               tuple(round_cols), heavy)
        return fn
    return deco
