"""Training and submission drivers.

``train_and_score`` is one country's ``run_*_model``: build features from
its recipe, fit on the train rows, score the test rows, and return the
country submission ``(id, country, poor)``. ``run_all`` stages household
sizes once as a country-partitioned table, does the three countries
(optionally concurrently from a driver thread pool: each country is an
independent set of Spark jobs) and unions them into one frame (U2).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import joins, metrics, sampling, schema
from hearth.plans.features import build_features
from hearth.plans.models import fit_model, label_column, score
from hearth.plans.recipes import RESAMPLE_SEED, Recipe
from hearth.session import parallel_map, scratch_path
from hearth.sources import io


def resample(train: DataFrame, how: str | None, seed: int = RESAMPLE_SEED) -> DataFrame:
    """R1/R2 dispatch; an unknown ``how`` raises (ledger D17)."""
    if how is None:
        return train
    if how == "down":
        return sampling.downsample(train, "poor", seed=seed)
    if how == "up":
        return sampling.upsample(train, "poor", seed=seed)
    raise ValueError(f"unknown resampling {how!r}")


def stage_households(hhold: DataFrame, indiv: DataFrame) -> DataFrame:
    """Count household sizes once for every country (one pass over the
    individuals, J1) and write the households as a table partitioned by
    ``country`` in the shared checkpoint folder. The written table survives
    executor loss, cuts the lineage, and each country's fit then reads only
    its own partition (partition pruning)."""
    spark = hhold.sparkSession
    path = scratch_path(spark, "households")
    joins.num_indiv(hhold, indiv.select("id")).write.mode("overwrite").partitionBy("country").parquet(path)
    return spark.read.parquet(path)


def train_and_score(recipe: Recipe, hhold: DataFrame, indiv: DataFrame | None) -> DataFrame:
    """M9: fit a country's model on its train rows and score its test rows.
    ``indiv=None`` when ``hhold`` already carries ``num_indiv`` (staged)."""
    ff = build_features(recipe, hhold, indiv)
    train = label_column(ff.df.where(F.col("_split") == "train"))
    train = resample(train, recipe.resample)
    model = fit_model(train, ff.feature_cols, recipe.model, cat_cols=ff.cat_cols)
    test = ff.df.where(F.col("_split") == "test")
    return metrics.country_submission(score(model, test), recipe.country)


def run_all(recipes: Mapping[str, Recipe], hhold: DataFrame, indiv: DataFrame,
            parallel: bool = False) -> DataFrame:
    """All countries, concatenated into one submission frame.

    Household sizes are staged once (``stage_households``); the countries'
    fits are independent job sets and run concurrently with ``parallel``.
    Recipes that drop or rename individual columns do not change a count of
    rows, so one staging serves every country.
    """
    staged = stage_households(hhold, indiv)
    subs = parallel_map(lambda r: train_and_score(r, staged, None), recipes.values(), parallel)
    return schema.union_frames(subs)


def read_country(spark: SparkSession, folder: str, country: str, kind: str) -> DataFrame:
    """One country's train and test file of the survey layout, tagged by ``_split``
    (the test file has no target); types come from the train file."""
    known = io.read_csv_table(spark, io.survey_path(folder, country, kind, "train"))
    new = io.read_csv_like(spark, io.survey_path(folder, country, kind, "test"), known.schema)
    return schema.union_frames([known.withColumn("_split", F.lit("train")), new.withColumn("_split", F.lit("test"))])


def submit_survey(spark: SparkSession, folder: str, recipes: Mapping[str, Recipe], parallel: bool = True) -> DataFrame:
    """M12 on files ``{A,B,C}_{hhold,indiv}_{train,test}.csv``: one submission frame."""
    def one(r: Recipe) -> DataFrame:
        return train_and_score(r, read_country(spark, folder, r.country, "hhold"),
                               read_country(spark, folder, r.country, "indiv").drop("_split"))

    return schema.union_frames(parallel_map(one, recipes.values(), parallel))
