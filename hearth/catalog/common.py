"""Spark-side shared inputs of the catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.exprs import logistic
from hearth.operators.joins import num_indiv
from hearth.sources.tables import households, individuals


def hh(spark: SparkSession, sf: str) -> DataFrame:
    return households(spark, sf)


def ind(spark: SparkSession, sf: str) -> DataFrame:
    return individuals(spark, sf)


def ni(spark: SparkSession, sf: str) -> DataFrame:
    """Households with ``num_indiv``."""
    return num_indiv(hh(spark, sf), ind(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Households with the deterministic score ``p = logistic((num_indiv - 10) / 3)``
    used by the metric queries in place of a model (FIXTURES.md)."""
    return ni(spark, sf).withColumn("p", logistic((F.col("num_indiv") - 10) / F.lit(3.0)))


def train(df: DataFrame) -> DataFrame:
    return df.where(F.col("_split") == "train")
