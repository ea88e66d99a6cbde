"""Optimality of fitted logistic models, from the rows they were fitted on.

The penalised mean log loss of a logistic regression is convex: coefficients are
the fit if its gradient vanishes there. One aggregate over the rows gives it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import prob_of_class
from hearth.operators import sampling
from hearth.plans import cv
from hearth.plans.features import FeatureFrame
from hearth.plans.models import fit_model, label_column
from hearth.plans.recipes import FOLD_SEED, N_FOLDS, Recipe
from hearth.plans.train import parallel_map

#: A fit is taken for optimal if no component of the gradient of the mean loss is larger.
TOLERANCE = 1e-3


def largest_gradient(model: PipelineModel, rows: DataFrame, label: str = "label") -> tuple[int, float]:
    """Number of rows, and the largest absolute component of the gradient of the penalised mean
    log loss at the coefficients of the model's last stage (a binary logistic regression
    without standardisation), from ``rows``."""
    last = model.stages[-1]
    scored = model.transform(rows).select(
        last.getFeaturesCol(), (prob_of_class(last.getProbabilityCol(), 1) - F.col(label)).alias("residual"))
    x, r = F.col(last.getFeaturesCol()), F.col("residual")
    one = array_to_vector(F.array(F.lit(1.0)))
    parts = scored.agg(F.count(F.lit(1)).alias("n"), *(
        vector_to_array(Summarizer.sum(v, F.abs(r) * (r * sign > 0).cast("double"))).alias(f"{name}{sign}")
        for name, v in (("x", x), ("one", one)) for sign in (1, -1))).first()
    slopes = [(a - b) / parts.n + last.getRegParam() * w
              for a, b, w in zip(parts["x1"], parts["x-1"], last.coefficients.toArray(), strict=True)]
    level = (parts["one1"][0] - parts["one-1"][0]) / parts.n
    return parts.n, max(map(abs, [*slopes, level]))


def _report(spark, found: Sequence[tuple], *keys: str) -> DataFrame:
    return spark.createDataFrame([(*k, n, bool(g < TOLERANCE)) for *k, n, g in found],
                                 ", ".join([*keys, "n_rows long", "optimal boolean"]))


def cv_optimality(recipe: Recipe, hhold_train: DataFrame, indiv: DataFrame, k: int = N_FOLDS,
                  seed: int = FOLD_SEED) -> DataFrame:
    """The fits of ``cv.cross_validate``: ``country, fold, n_rows, optimal``."""
    h = cv.fold_households(recipe, hhold_train, indiv, k, seed)

    def one(f: int) -> tuple:
        ff = cv.fold_features(recipe, h, f)
        train = label_column(ff.df.where(F.col("_split") == "train"))
        model = fit_model(train, ff.feature_cols, recipe.model, cat_cols=ff.cat_cols)
        return recipe.country, f, *largest_gradient(model, train)

    try:
        return _report(h.sparkSession, parallel_map(one, range(k)), "country string", "fold long")
    finally:
        h.unpersist()


def penalty_optimality(frames: Mapping[str, FeatureFrame], penalties: Sequence[float]) -> DataFrame:
    """Logistic fits on all train rows under each penalty: ``country, penalty, n_rows, optimal``."""
    spark = next(iter(frames.values())).df.sparkSession
    rows = {c: label_column(ff.df.where(F.col("_split") == "train")).persist() for c, ff in frames.items()}

    def one(job: tuple[str, float]) -> tuple:
        c, penalty = job
        spec = {"kind": "logistic", "C": 1.0 / (penalty * rows[c].count())}
        model = fit_model(rows[c], frames[c].feature_cols, spec, cat_cols=frames[c].cat_cols)
        return c, penalty, *largest_gradient(model, rows[c])

    try:
        return _report(spark, parallel_map(one, [(c, p) for c in frames for p in penalties]), "country string", "penalty double")
    finally:
        for d in rows.values():
            d.unpersist()


def adversarial_optimality(frames: Mapping[str, FeatureFrame], spec: dict, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """The fits of ``experiments.adversarial_validation``: ``country, n_rows, optimal``."""
    def one(c: str) -> tuple:
        d = frames[c].df.withColumn("is_test", F.col("_split") == "test").drop("poor")
        d = sampling.stratified_holdout(d, test_size=test_size, label="is_test", seed=seed, split_col="_adv")
        train = d.where(F.col("_adv") == "train").withColumn("label", F.col("is_test").cast("double"))
        model = fit_model(train, frames[c].feature_cols, spec, cat_cols=frames[c].cat_cols)
        return c, *largest_gradient(model, train)

    spark = next(iter(frames.values())).df.sparkSession
    return _report(spark, parallel_map(one, frames), "country string")
