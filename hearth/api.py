"""Entry points under the names a user of the reference calls, on Spark.

Each function keeps the reference's name and option names and maps them to
the DataFrame operators of this library. Differences that follow from Spark
(no row index, lazy frames, one table with a ``country`` tag instead of one
file per country) are noted per function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import encode, metrics, profile, sampling, schema
from hearth.plans import cv
from hearth.plans.recipes import Recipe, standin_recipes
from hearth.plans.train import train_and_score
from hearth.sources import io, tables

COUNTRIES = ("A", "B", "C")


def _per_country(df: DataFrame) -> tuple[DataFrame, ...]:
    return tuple(df.where(F.col("country") == c) for c in COUNTRIES)


def load_hhold_train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Household train frames of countries A, B, C (filters of one table)."""
    return _per_country(io.load_hhold(spark, sf_dir, "train"))


def load_hhold_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return _per_country(io.load_hhold(spark, sf_dir, "test"))


def load_indiv_train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Individual train frames per country (country comes from the household)."""
    ind = io.load_indiv(spark, sf_dir, "train")
    hh = tables.households(spark, sf_dir).select("id", "country")
    return _per_country(ind.join(hh, "id", "inner"))


def load_indiv_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    ind = io.load_indiv(spark, sf_dir, "test")
    hh = tables.households(spark, sf_dir).select("id", "country")
    return _per_country(ind.join(hh, "id", "inner"))


def select_numerical(df: DataFrame) -> DataFrame:
    return schema.select_numerical(df)


def select_categorical(df: DataFrame) -> DataFrame:
    return schema.select_categorical(df)


def standardize(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every numeric feature column (or ``cols``) scaled by the frame's own mean and std."""
    return encode.standardize(df, list(cols) if cols is not None else schema.numeric_columns(df))


def min_max_scaler(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return encode.min_max_scale(df, list(cols) if cols is not None else schema.numeric_columns(df))


def enforce_cols(test: DataFrame, train_cols: Sequence[str]) -> DataFrame:
    """Test frame with exactly train's columns, in train's order; absent ones are 0."""
    return schema.enforce_cols(test, train_cols)


def pre_process_data(df: DataFrame, normalize_num: str | None = "standardize",
                     enforce_cols: Sequence[str] | None = None, fillmean: str | None = None,
                     categorical: str | None = "label_encoder", vocab_from: DataFrame | None = None) -> DataFrame:
    """The composite: scale, encode, align, fill (see ``encode.preprocess``)."""
    return encode.preprocess(df, normalize_num=normalize_num, enforce=enforce_cols, fillmean=fillmean,
                             categorical=categorical, vocab_from=vocab_from)


def make_country_sub(scored: DataFrame, country: str, score: str = "p") -> DataFrame:
    """``(id, country, poor)`` from a frame holding ``id`` and the P(poor) column."""
    return metrics.country_submission(scored, country, score)


def resample_data(df: DataFrame, how: str = "down", seed: int = 144) -> DataFrame:
    """Balance classes of ``poor``: 'down' (without replacement) or 'up' (with)."""
    if how == "down":
        return sampling.downsample(df, "poor", seed=seed)
    if how == "up":
        return sampling.upsample(df, "poor", seed=seed)
    raise ValueError(f"unknown how {how!r}")


def run_CV(X: DataFrame, model: dict, func: Callable[[DataFrame], DataFrame] | None = None,  # noqa: N802
           n_splits: int = 3, how: str | None = "up", categorical: str = "label_encoder") -> DataFrame:
    """Generic CV harness; ``model`` is a model spec such as ``{"kind": "logistic", "C": 1}``.
    Returns ``(fold, log_loss)`` rows."""
    return cv.run_cv(X, model, func=func, n_splits=n_splits, how=how, categorical=categorical)


def mean_log_loss(a_logloss: DataFrame, b_logloss: DataFrame, c_logloss: DataFrame) -> DataFrame:
    """Fold log losses of the three countries (``log_loss`` column), averaged per
    country and weighted by the countries' test sizes."""
    per = schema.union_frames([f.select(F.lit(c).alias("country"), "log_loss")
                               for c, f in zip(COUNTRIES, (a_logloss, b_logloss, c_logloss))])
    return metrics.weighted_country_mean(per.groupBy("country").agg(F.avg("log_loss").alias("log_loss")))


def print_confusion_matrix(df: DataFrame, label: str = "poor", pred: str = "pred",
                           class_names: Sequence[str] = ("False", "True")) -> DataFrame:
    """The labelled confusion table (the drawing itself is not built)."""
    return metrics.confusion_table(df, label, F.col(pred), class_names=tuple(class_names))


def target_ratio(df: DataFrame) -> DataFrame:
    """Percent of positive households per country."""
    return profile.target_ratio(df)


def run_country_model(spark: SparkSession, sf_dir: str, country: str,
                      recipes: dict[str, Recipe] | None = None) -> DataFrame:
    """``run_a_model`` / ``run_b_model`` / ``run_c_model``: the country's test
    households scored by its recipe's model."""
    r = (recipes or standin_recipes())[country]
    return train_and_score(r, tables.households(spark, sf_dir), tables.individuals(spark, sf_dir))


def run_a_model(spark: SparkSession, sf_dir: str, recipes: dict[str, Recipe] | None = None) -> DataFrame:
    return run_country_model(spark, sf_dir, "A", recipes)


def run_b_model(spark: SparkSession, sf_dir: str, recipes: dict[str, Recipe] | None = None) -> DataFrame:
    return run_country_model(spark, sf_dir, "B", recipes)


def run_c_model(spark: SparkSession, sf_dir: str, recipes: dict[str, Recipe] | None = None) -> DataFrame:
    return run_country_model(spark, sf_dir, "C", recipes)


def _train_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.households(spark, sf_dir).where(F.col("_split") == "train")


def skfCV_A(spark: SparkSession, sf_dir: str, recipes: dict[str, Recipe] | None = None) -> DataFrame:  # noqa: N802
    """3-fold stratified CV of country A: ``(country, fold, metric, value)``."""
    r = (recipes or standin_recipes())["A"]
    return cv.cross_validate(r, _train_households(spark, sf_dir), tables.individuals(spark, sf_dir))


def skfCV_B(spark: SparkSession, sf_dir: str, resampled: bool = False,  # noqa: N802
            recipes: dict[str, Recipe] | None = None, seed: int = 0) -> DataFrame:
    """Country B's 95/5 stratified holdout (``resampled=True``: downsampled train part)."""
    r = (recipes or standin_recipes())["B"]
    return cv.holdout_validate(r, _train_households(spark, sf_dir), tables.individuals(spark, sf_dir),
                               seed=seed, how="down" if resampled else None)


def skfCV_C(spark: SparkSession, sf_dir: str, recipes: dict[str, Recipe] | None = None) -> DataFrame:  # noqa: N802
    """3-fold stratified CV of country C (its CV recipe: logistic regression, C=2)."""
    if recipes is not None:
        r = recipes["C"]
    else:
        r = Recipe("C", drop_string_cats=True, standardize=["num_indiv"], encode_all_but_numeric=True,
                   model={"kind": "logistic", "C": 2.0})
    return cv.cross_validate(r, _train_households(spark, sf_dir), tables.individuals(spark, sf_dir))
