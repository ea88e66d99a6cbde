"""From raw documents to packed training sequences: four stages over ``documents``.

Every stage is a written table that the next one reads. Documents that the
toxicity model or the quality rules reject go, one document of each
near-duplicate class stays, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearth.llm import neardup, packing, quality, toxicity
from hearth.llm.common import read, staged
from hearth.llm.queries import tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5 (operator 8)."""
    return toxicity.keep_ordinary(docs, toxicity_model(spark, docs, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 1)."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (operator 10)."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, placed in sequences of 1024 tokens (operator 7)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_good),
          ("minhash_near_dedup", drop_near_duplicates), ("best_fit_packing", pack)]

#: Models and hash signatures are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
