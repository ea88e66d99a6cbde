"""Catalog: model fits, drivers and experiments (M1-M16). Not SQL-expressible:
the driver checks these by rows only.

Every query runs the recipes' own parameters (100 and 400 boosted trees) on all
rows of its countries. Spark ML runs one job per tree level, so the fits take
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.catalog.common import hh, ind, ni
from hearth.catalog.registry import query
from hearth.operators import schema
from hearth.plans import cv, experiments, train
from hearth.plans.features import build_features
from hearth.plans.recipes import REFERENCE_MODELS, Recipe, standin_recipes

#: Trees of the benchmark forest (the library's usual default, as the reference leaves it open).
FOREST_TREES = 100


def _recipes():
    return standin_recipes()


def _hh_ind(spark, sf):
    return hh(spark, sf), ind(spark, sf)


@query("m1_gbt_country_a", heavy=True)
def m1(spark, sf):
    """M1/M8/M9: country A boosted trees (depth 5, subsample 0.5, seed 144); test rows scored."""
    h, i = _hh_ind(spark, sf)
    return train.train_and_score(_recipes()["A"], h, i)


@query("m1_gbt_country_a_sparse", heavy=True)
def m1_sparse(spark, sf):
    """M1 with the wide-data encoding: categories in a sparse vector
    (StringIndexer + OneHotEncoder) instead of dense 0/1 columns."""
    h, i = _hh_ind(spark, sf)
    r = _recipes()["A"]
    r.sparse = True
    return train.train_and_score(r, h, i)


@query("m2_gbt_country_b", heavy=True)
def m2(spark, sf):
    """M2/M9: country B boosted trees (depth 3, min 5 rows per node)."""
    h, i = _hh_ind(spark, sf)
    return train.train_and_score(_recipes()["B"], h, i)


@query("m3_gbt_country_c", heavy=True)
def m3(spark, sf):
    """M3/M9: country C boosted trees on binned num_indiv."""
    h, i = _hh_ind(spark, sf)
    return train.train_and_score(_recipes()["C"], h, i)


def _cv_c_recipe() -> Recipe:
    """Country C's cross-validation recipe: num_indiv standardised (not binned), logistic C=2."""
    return Recipe("C", drop_string_cats=True, standardize=["num_indiv"], encode_all_but_numeric=True,
                  model=dict(REFERENCE_MODELS["C_cv"]))


@query("m4_logistic_cv_c", heavy=True)
def m4(spark, sf):
    """3-fold stratified CV of country C with l2 logistic regression (C=2)."""
    h, i = _hh_ind(spark, sf)
    return cv.cross_validate(_cv_c_recipe(), h.where(F.col("_split") == "train"), i)


@query("m5_random_forest_all", heavy=True)
def m5(spark, sf):
    """The benchmark: random forests for all countries, one submission."""
    rs = _recipes()
    for r in rs.values():
        r.model = {"kind": "random_forest", "n_estimators": FOREST_TREES, "max_depth": 5, "seed": 144}
    h, i = _hh_ind(spark, sf)
    return train.run_all(rs, h, i, parallel=True)


@query("m7_linear_svc_a", heavy=True)
def m7(spark, sf):
    """M7: linear SVC on country A, scored by the logistic of the margin."""
    r = _recipes()["A"]
    r.model = {"kind": "linear_svc", "reg": 0.01, "max_iter": 50}
    h, i = _hh_ind(spark, sf)
    return train.train_and_score(r, h, i)


@query("m10_cv_country_a", heavy=True)
def m10a(spark, sf):
    """M10 ``skfCV_A``: 3-fold stratified CV (seed 2) of the country A recipe."""
    h, i = _hh_ind(spark, sf)
    return cv.cross_validate(_recipes()["A"], h.where(F.col("_split") == "train"), i)


@query("m10_holdout_b", heavy=True)
def m10b(spark, sf):
    """95/5 stratified holdout of country B, no resampling."""
    h, i = _hh_ind(spark, sf)
    return cv.holdout_validate(_recipes()["B"], h.where(F.col("_split") == "train"), i, seed=0)


@query("m10_holdout_b_downsampled", heavy=True)
def m10b_down(spark, sf):
    """The same holdout with the train part downsampled."""
    h, i = _hh_ind(spark, sf)
    return cv.holdout_validate(_recipes()["B"], h.where(F.col("_split") == "train"), i, seed=0, how="down")


def _per_country(fn) -> DataFrame:
    """One result per country, tagged ``country`` and concatenated; countries run side by side."""
    return schema.union_frames(train.parallel_map(
        lambda item: fn(item[1]).withColumn("country", F.lit(item[0])), _recipes().items()))


@query("m11_run_cv_generic", heavy=True)
def m11(spark, sf):
    """M11 ``run_CV`` per country: generic harness, upsampling, a user feature function,
    label encoding, logistic regression; log loss per fold."""
    d = ni(spark, sf).where(F.col("_split") == "train").select(
        "id", "country", "poor", "c_mktsegment", "c_nationkey", "num_indiv")

    def func(df):
        return df.withColumn("big_household", (F.col("num_indiv") > 10).cast("int"))

    return _per_country(lambda r: cv.run_cv(d.where(F.col("country") == r.country).drop("country"),
                                            {"kind": "logistic", "C": 1.0}, func=func, n_splits=3, how="up"))


@query("m12_all_countries_submission", heavy=True)
def m12(spark, sf):
    """The three country models (fitted concurrently), one concatenated submission."""
    h, i = _hh_ind(spark, sf)
    return train.run_all(_recipes(), h, i, parallel=True)


def _features(spark, sf, recipe):
    h, i = _hh_ind(spark, sf)
    return build_features(recipe, h, i)


@query("m13_grid_search", heavy=True)
def m13(spark, sf):
    """M13 per country: grid search of the l2 strength of a logistic model over 3 stratified folds."""
    return _per_country(lambda r: experiments.grid_search(
        _features(spark, sf, r), {"kind": "logistic", "C": 1.0}, {"regParam": [0.001, 0.01, 0.1]}))


@query("m14_stacking", heavy=True)
def m14(spark, sf):
    """M14, all countries: stacking of country A's boosted trees and logistic regression under a
    logistic meta model."""
    base = [dict(REFERENCE_MODELS["A"]), {"kind": "logistic", "C": 2.0}]
    return experiments.stack_all({c: _features(spark, sf, r) for c, r in _recipes().items()}, base)


@query("m16_adversarial_validation", heavy=True)
def m16(spark, sf):
    """M16 per country: train-vs-test classifier AUC (about 0.5 when they look alike)."""
    return _per_country(lambda r: experiments.adversarial_validation(
        _features(spark, sf, r), {"kind": "logistic", "C": 1.0}))
