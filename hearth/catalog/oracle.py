"""Compare a registered query's Spark result with its DuckDB oracle SQL.

Same rule as the driver's check: equal column names (order free), equal
row counts, equal multisets of rows with doubles rounded to 6 places.
"""

from __future__ import annotations

import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TYPE_NAMES = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
              "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "ShortType()": "SMALLINT",
              "FloatType()": "FLOAT", "TimestampType()": "TIMESTAMP"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        return ("~nan",) if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, entry, sf_dir: str) -> tuple[bool, str]:
    """Run one registry entry both ways; (ok, message)."""
    df = entry.fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(df.columns) != sorted(dcols):
        return False, f"columns spark={sorted(df.columns)} duck={sorted(dcols)}"
    stypes = {f.name: TYPE_NAMES.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in res.description}
    tdiff = {c: (stypes[c], dtypes[c]) for c in df.columns if stypes[c] != dtypes.get(c)}
    if tdiff:
        return False, f"types {tdiff}"
    a, b = _rows(df.columns, srows), _rows(dcols, drows)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (f"rows spark={len(a)} duck={len(b)} spark-only={[x for x in a if x not in sb][:2]} "
                       f"duck-only={[x for x in b if x not in sa][:2]}")
    return True, f"{len(a)} rows"
