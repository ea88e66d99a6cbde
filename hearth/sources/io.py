"""Loaders (S1-S4), sinks (S5, S6) and the preview/shape operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StringType, StructField, StructType

from hearth.operators.schema import union_frames
from hearth.session import scratch_path
from hearth.sources.tables import households, individuals

SUBMISSION_SCHEMA = StructType([
    StructField("id", LongType(), False),
    StructField("country", StringType(), False),
    StructField("poor", DoubleType(), True),
])

METRICS_SCHEMA = StructType([
    StructField("country", StringType(), True),
    StructField("fold", LongType(), True),
    StructField("metric", StringType(), False),
    StructField("value", DoubleType(), True),
])


def load_hhold(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """The household file of one split; test rows carry no target."""
    h = households(spark, sf_dir).where(F.col("_split") == split)
    if split == "test":
        h = h.drop("poor")
    return h


def load_indiv(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """The individual file of one split."""
    return individuals(spark, sf_dir).where(F.col("_split") == split)


def read_csv_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV source; NaN -> NULL in float and double columns. With a schema there is no
    inference pass; without one the types come from the file."""
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.select(*[
        F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_csv_like(spark: SparkSession, path: str, like: StructType) -> DataFrame:
    """CSV source with the types of ``like`` for its columns, by name (others are text): a test file gets
    the types of its train file instead of types of its own. A value that has not the type is NULL."""
    types = {f.name: f.dataType for f in like.fields}
    df = spark.read.option("header", True).csv(path)

    def typed(name: str):
        kind = types.get(name, StringType())
        value = F.col(f"`{name}`").try_cast(kind)
        return (F.nanvl(value, F.lit(None).cast(kind)) if isinstance(kind, (DoubleType, FloatType)) else value).alias(name)

    return df.select(*map(typed, df.columns))


def survey_path(folder: str, country: str, kind: str, split: str) -> str:
    """The reference's file layout: ``{A,B,C}_{hhold,indiv}_{train,test}.csv``."""
    return f"{folder.rstrip('/')}/{country}_{kind}_{split}.csv"


def write_survey(df: DataFrame, folder: str, kind: str, split: str, countries: Sequence[str] = ("A", "B", "C")) -> str:
    """Write one kind and split as a CSV with header per country."""
    for c in countries:
        df.where(F.col("country") == c).write.option("header", True).csv(survey_path(folder, c, kind, split))
    return folder


def read_survey(spark: SparkSession, folder: str, kind: str, split: str, schema: StructType | None = None,
                countries: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """One kind and split of all countries, concatenated by column name (a
    country's own columns are NULL for the others)."""
    return union_frames([read_csv_table(spark, survey_path(folder, c, kind, split), schema) for c in countries])


def survey_roundtrip(spark: SparkSession, df: DataFrame, kind: str, split: str) -> DataFrame:
    """Write the layout into the shared checkpoint folder and read it back."""
    return read_survey(spark, write_survey(df, scratch_path(spark, "survey"), kind, split), kind, split, df.schema)


def write_submission(df: DataFrame, path: str, partition_by_country: bool = False) -> str:
    """Write ``(id, country, poor)`` as CSV with a header."""
    out = df.select(F.col("id").cast("long"), F.col("country").cast("string"),
                    F.col("poor").cast("double"))
    w = out.write.mode("overwrite").option("header", True)
    if partition_by_country:
        w = w.partitionBy("country")
    w.csv(path)
    return path


def submission_roundtrip(spark: SparkSession, df: DataFrame, partition_by_country: bool = False) -> DataFrame:
    """Write the submission into the shared checkpoint folder and read it back."""
    path = scratch_path(spark, "submission")
    write_submission(df, path, partition_by_country)
    schema = SUBMISSION_SCHEMA if not partition_by_country else StructType(
        [f for f in SUBMISSION_SCHEMA.fields if f.name != "country"])
    back = read_csv_table(spark, path, schema)
    return back.select("id", "country", "poor") if partition_by_country else back


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Persist a metrics frame ``(country, fold, metric, value)``."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def metrics_roundtrip(spark: SparkSession, df: DataFrame, fmt: str = "json") -> DataFrame:
    path = scratch_path(spark, "metrics")
    write_metrics(df, path, fmt)
    return spark.read.schema(METRICS_SCHEMA).format(fmt).load(path)


def shape(df: DataFrame) -> DataFrame:
    """``df.shape`` as a one-row frame (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))


def head(df: DataFrame, n: int = 5, order_by: str | None = "id") -> DataFrame:
    """``df.head(n)``; ordered by a key so the preview is deterministic."""
    return (df.orderBy(order_by) if order_by else df).limit(n)
