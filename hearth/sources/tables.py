"""Reading the given parquet tables and shaping them into the survey data model.

The survey model has a *household* table (key ``id``, partition tag
``country``, boolean target ``poor``, a split tag ``_split``) and an
*individual* table (``id`` of the parent household, ``iid``). The functions
here only rename and tag columns of the input tables so they have that
schema (FIXTURES.md part 2); every operator then works on any data of that
schema. Column selection is explicit so the parquet scan reads only what a
query uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def country_of(nation_key: F.Column) -> F.Column:
    """Partition tag A/B/C of a household (stand-in rule: nation key mod 3)."""
    r = F.pmod(nation_key, F.lit(3))
    return F.when(r == 0, "A").when(r == 1, "B").otherwise("C")


def split_of(key: F.Column) -> F.Column:
    """Stand-in train/test tag: about 3/16 of households, chosen by the first
    hex digit of md5(key), are the unlabelled test file."""
    return F.when(F.substring(F.md5(key.cast("string")), 1, 1).isin("0", "1", "2"),
                  F.lit("test")).otherwise(F.lit("train"))


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All households (train and test) with ``_split``; ``poor`` is NULL on test rows.

    customer -> id, country, poor (c_acctbal < 0, never a feature),
    c_mktsegment (string categorical), c_nationkey (integer used as a category).
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                    "c_mktsegment")
    split = split_of(F.col("c_custkey"))
    return c.select(
        F.col("c_custkey").alias("id"),
        country_of(F.col("c_nationkey")).alias("country"),
        F.when(split == "train", F.col("c_acctbal") < 0).alias("poor"),
        F.col("c_mktsegment"),
        F.col("c_nationkey"),
        split.alias("_split"),
    )


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All individuals: orders -> id (o_custkey), iid (o_orderkey) and person features."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("iid"),
        F.col("o_orderstatus"),
        F.col("o_totalprice"),
        F.col("o_orderpriority"),
        split_of(F.col("o_custkey")).alias("_split"),
    )


def households_childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second household shape where some households have no individual: orders."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus"),
                    F.col("o_totalprice"))


def individuals_childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as individuals of orders; (id, iid) is not unique here."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("iid"),
                     F.col("l_quantity"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels: labelled rows are train, the others test.

    id = doc_id, target ``poor`` := toxic = 1 (NULL when unlabelled),
    features n_chars (numeric > 0), lang, source (strings).
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("id"),
        F.lit("A").alias("country"),
        (F.col("toxic") == 1).alias("poor"),
        F.col("n_chars"), F.col("lang"), F.col("source"),
        F.when(F.col("toxic").isNull(), "test").otherwise("train").alias("_split"),
    )
