"""Cross-validation drivers.

Folds are a column (R3/R4), so a fold's train and validation parts are
filters of one frame. Household sizes come from the individuals of the
country's households (J1) once, not once per fold, and
the coverage check (J3) reads them. Metrics of every fold come back as one
``(country, fold, metric, value)`` frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hearth.operators import encode, joins, metrics, sampling, schema
from hearth.plans.features import KEYS, FeatureFrame, build_features
from hearth.plans.models import fit_model, label_column, score
from hearth.plans.recipes import FOLD_SEED, N_FOLDS, Recipe
from hearth.plans.train import parallel_map, resample

REPORT_METRICS = ("log_loss", "f1", "precision", "recall", "balanced_auc")


class CoverageError(AssertionError):
    pass


def check_coverage(hhold_with_sizes: DataFrame) -> None:
    """J3 run-time check: at least one household of the part has an
    individual (the reference's ``any``), read off ``num_indiv``."""
    if not hhold_with_sizes.where(F.col("num_indiv") > 0).take(1):
        raise CoverageError("no household of the fold has an individual")


def fold_households(recipe: Recipe, hhold_train: DataFrame, indiv: DataFrame, k: int = N_FOLDS,
                    seed: int = FOLD_SEED) -> DataFrame:
    """A country's households with their size and fold (R3), persisted."""
    h = hhold_train.where(F.col("country") == recipe.country)
    ind = schema.rename_columns(schema.drop_columns(indiv, recipe.drop_indiv), recipe.rename_indiv)
    h = joins.num_indiv(h, ind.select("id"))  # a left join from h: other households' individuals fall away
    return sampling.stratified_kfold(h, k=k, seed=seed).persist()


def fold_features(recipe: Recipe, h: DataFrame, f: int) -> FeatureFrame:
    """Features of fold ``f``: its own rows are the test part, all others the train part."""
    part = h.withColumn("_split", F.when(F.col("fold") == f, "test").otherwise("train")).drop("fold")
    check_coverage(part.where(F.col("_split") == "train"))
    return build_features(recipe, part, None)


def cross_validate(recipe: Recipe, hhold_train: DataFrame, indiv: DataFrame, k: int = N_FOLDS,
                   seed: int = FOLD_SEED, how: str | None = None,
                   model: dict | Estimator | None = None, parallel: bool = True) -> DataFrame:
    """M10 ``skfCV_*``: stratified k-fold CV of a country's recipe.

    Household sizes are counted once (J1) and persisted with the fold column; per fold the
    validation households are fold f and the train households the others.
    Features are built with each part's own scaling statistics (reference
    parity) and a joint vocabulary; the train part is optionally resampled;
    the model is fitted and the validation part scored.
    """
    h = fold_households(recipe, hhold_train, indiv, k, seed)

    def one_fold(f: int) -> DataFrame:
        ff = fold_features(recipe, h, f)
        train = resample(label_column(ff.df.where(F.col("_split") == "train")), how)
        fitted = fit_model(train, ff.feature_cols, model or recipe.model, cat_cols=ff.cat_cols)
        val = score(fitted, ff.df.where(F.col("_split") == "test"))
        rep = metrics.classification_report(val, "poor", "p").withColumn("fold", F.lit(f).cast("long"))
        return rep.withColumn("country", F.lit(recipe.country))

    try:
        rep = schema.union_frames(parallel_map(one_fold, range(k), parallel))
        out = metrics.long_metrics(rep, ["country", "fold"], REPORT_METRICS)
        # the metrics are k x 5 numbers: materialise them before releasing the cache
        rows = out.collect()
    finally:
        h.unpersist()
    return out.sparkSession.createDataFrame(rows, out.schema)


def holdout_validate(recipe: Recipe, hhold_train: DataFrame, indiv: DataFrame, test_size: float = 0.05,
                     seed: int = 0, how: str | None = None, model: dict | Estimator | None = None) -> DataFrame:
    """M10 holdout form (with or without resampling): one stratified holdout (R5), the
    confusion counts and metrics of the validation part."""
    h = hhold_train.where(F.col("country") == recipe.country)
    ind = schema.rename_columns(schema.drop_columns(indiv, recipe.drop_indiv), recipe.rename_indiv)
    h = joins.num_indiv(h, ind.select("id"))  # a left join from h: other households' individuals fall away
    h = sampling.stratified_holdout(h, test_size=test_size, seed=seed, split_col="_split").persist()
    try:
        check_coverage(h.where(F.col("_split") == "train"))
        ff = build_features(recipe, h, None)
        train = resample(label_column(ff.df.where(F.col("_split") == "train")), how)
        fitted = fit_model(train, ff.feature_cols, model or recipe.model, cat_cols=ff.cat_cols)
        val = score(fitted, ff.df.where(F.col("_split") == "test"))
        out = metrics.classification_report(val, "poor", "p").withColumn("country", F.lit(recipe.country))
        rows = out.collect()  # one row
    finally:
        h.unpersist()
    return out.sparkSession.createDataFrame(rows, out.schema)


def run_cv(df: DataFrame, spec: dict | Estimator, func: Callable[[DataFrame], DataFrame] | None = None, n_splits: int = 3,
           how: str | None = "up", categorical: str = "label_encoder", label: str = "poor",
           keys: Sequence[str] = KEYS, parallel: bool = True) -> DataFrame:
    """M11 generic harness ``run_CV``: unshuffled stratified folds (R4) ->
    resample the train part -> user ``func`` (its returned frame is used,
    ledger D13) -> ``preprocess`` (train vocabulary and columns enforced on
    validation, D5/D6) -> fit -> log loss per fold. The target is never a
    feature (D12)."""
    folds = sampling.stratified_kfold_ordered(df, k=n_splits, label=label).persist()

    def one_fold(f: int) -> DataFrame:
        tr = resample(folds.where(F.col("fold") != f), how)
        va = folds.where(F.col("fold") == f)
        if func is not None:
            tr, va = func(tr), func(va)
        tr_p = encode.preprocess(tr, categorical=categorical, keys=keys)
        cols = [c.name for c in tr_p.schema.fields if c.name not in keys and isinstance(c.dataType, NumericType)]
        va_p = encode.preprocess(va, categorical=categorical, keys=keys, vocab_from=tr,
                                 enforce=[*[k for k in keys if k in tr_p.columns], *cols])
        fitted = fit_model(label_column(tr_p, label), cols, spec)
        return metrics.log_loss(score(fitted, va_p), label, "p").withColumn("fold", F.lit(f).cast("long"))

    try:
        out = schema.union_frames(parallel_map(one_fold, range(n_splits), parallel)).select("fold", "log_loss")
        rows = out.collect()  # one row per fold
    finally:
        folds.unpersist()
    return out.sparkSession.createDataFrame(rows, out.schema)
