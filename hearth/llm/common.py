"""Shared helpers of the corpus operators."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearth.session import scratch_path

#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder of ``spark.checkpoint.dir`` and
    read it back: later steps start from the files, so a lost executor costs at
    most the running stage, and no step is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_store(owner: str) -> dict:
    """A dict of an operator that lives in the Python worker until another operator asks for
    its own: workers are reused by the stages of a pipeline, and one stage's tables go with it."""
    store = sys.modules.setdefault("_hearth_llm_store", types.ModuleType("_hearth_llm_store"))
    if store.__dict__.get("owner") != owner:
        store.owner, store.kept = owner, {}
    return store.kept


def crc_of(doc_id: int | None) -> int | None:
    """crc32 of a document id written as text (the folds' hash)."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """True on the held-out fold: crc32(doc_id as text) mod ``mod`` = ``remainder``.
    A document without an id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))


def text_key(text: Column) -> Column:
    """128-bit key of a text (null counts as empty): equal texts share it."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def map_rows(df: DataFrame, schema: StructType,
             fn: Callable[[Iterator[dict[str, pa.Array]]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` whose function sees each batch as ``{column: Arrow array}`` and
    yields ``{column: values}`` (lists, numpy or Arrow arrays); partitions stream, one batch at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := out[f.name], pa.Array)
                                              else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The column's texts one at a time; null counts as empty."""
    return (v.as_py() or "" for v in column)
