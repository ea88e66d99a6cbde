"""Model checks (rows only): probabilities in [0, 1], one row per scored
household, same seed -> same result, and the resampling trade-off."""

from pyspark.sql import functions as F

from hearth.plans import cv, train
from hearth.plans.recipes import standin_recipes
from hearth.sources.tables import households, individuals
from tests.conftest import SF_MID, SF_SMALL


def test_country_model_scores(spark):
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    r = standin_recipes({"n_estimators": 5})["A"]
    out = train.train_and_score(r, h, i)
    rows = out.collect()
    n_test = h.where((F.col("_split") == "test") & (F.col("country") == "A")).count()
    assert len(rows) == n_test
    assert all(0.0 <= x.poor <= 1.0 for x in rows)
    again = {x.id: x.poor for x in train.train_and_score(r, h, i).collect()}
    assert again == {x.id: x.poor for x in rows}


def test_downsampling_trades_log_loss_for_recall(spark):
    h, i = households(spark, SF_MID), individuals(spark, SF_MID)
    r = standin_recipes({"n_estimators": 5})["B"]
    t = h.where(F.col("_split") == "train")
    plain = cv.holdout_validate(r, t, i, test_size=0.2, seed=0).first()
    down = cv.holdout_validate(r, t, i, test_size=0.2, seed=0, how="down").first()
    assert down.recall >= plain.recall
    assert down.log_loss >= plain.log_loss


def test_unknown_resampling_raises(spark):
    import pytest
    df = households(spark, SF_SMALL).where(F.col("_split") == "train")
    with pytest.raises(ValueError):
        train.resample(df, "sideways")


def test_sparse_encoding_path(spark):
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    r = standin_recipes({"n_estimators": 5})["A"]
    r.sparse = True
    rows = train.train_and_score(r, h, i).collect()
    n_test = h.where((F.col("_split") == "test") & (F.col("country") == "A")).count()
    assert len(rows) == n_test and all(0.0 <= x.poor <= 1.0 for x in rows)


def test_staged_households_prune_partitions(spark):
    from tests.test_plans import _plan
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    staged = train.stage_households(h, i)
    p = _plan(staged.where(F.col("country") == "B").select("id", "num_indiv"))
    assert "PartitionFilters: [isnotnull(country" in p and "(country#" in p
    assert staged.agg(F.sum("num_indiv")).first()[0] == i.count()


def test_recipe_feature_columns(spark):
    from hearth.plans.features import build_features
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    rs = standin_recipes()
    a = build_features(rs["A"], h, i)
    assert "num_indiv" in a.feature_cols
    assert any(c.startswith("c_mktsegment_") for c in a.feature_cols)
    assert any(c.startswith("c_nationkey_") for c in a.feature_cols)
    b = build_features(rs["B"], h, i)
    assert "num_indiv" in b.feature_cols
    assert not any(c.startswith("c_mktsegment") for c in b.feature_cols)
    assert all(c == "num_indiv" or c.startswith("c_nationkey_") for c in b.feature_cols)
    c = build_features(rs["C"], h, i)
    assert "num_indiv" not in c.feature_cols
    assert {x for x in c.feature_cols if x.startswith("num_indiv_")} <= {
        "num_indiv_0-3", "num_indiv_3-5", "num_indiv_5-10", "num_indiv_10-13", "num_indiv_16+"}
    assert any(x.startswith("num_indiv_") for x in c.feature_cols)
    # standardised per split: train rows of A have mean 0 for num_indiv
    m = a.df.where(F.col("_split") == "train").agg(F.avg("num_indiv")).first()[0]
    assert abs(m) < 1e-9


def test_parallel_cv_equals_sequential(spark):
    h, i = households(spark, SF_MID), individuals(spark, SF_MID)
    r = standin_recipes({"n_estimators": 3})["A"]
    t = h.where(F.col("_split") == "train")
    par = {(x.fold, x.metric): x.value for x in cv.cross_validate(r, t, i, parallel=True).collect()}
    seq = {(x.fold, x.metric): x.value for x in cv.cross_validate(r, t, i, parallel=False).collect()}
    assert par.keys() == seq.keys()
    for key in par:
        assert par[key] == seq[key]


def test_any_estimator_plugs_in(spark):
    from pyspark.ml.classification import NaiveBayes
    from hearth.plans.models import fit_model, label_column, score
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    from hearth.operators import joins
    t = label_column(joins.num_indiv(h.where(F.col("_split") == "train"), i)).withColumn(
        "num_indiv", F.col("num_indiv").cast("double"))
    m = fit_model(t, ["num_indiv"], NaiveBayes(featuresCol="features", labelCol="label"))
    assert score(m, t).where((F.col("p") < 0) | (F.col("p") > 1)).count() == 0


def test_fits_do_not_depend_on_the_input_layout(spark):
    """Bags are drawn by partition: dealt rows give the same partitions from any layout."""
    from hearth.plans import models
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    from hearth.plans.features import build_features
    ff = build_features(standin_recipes()["A"], h, i)
    d = models.label_column(ff.df.where(F.col("_split") == "train"))
    spec = {"kind": "gbt", "n_estimators": 3, "max_depth": 3, "subsample": 0.5, "seed": 144}
    out = []
    for parts in (3, 17):
        m = models.fit_model(d.repartition(parts), ff.feature_cols, spec)
        out.append({r.id: r.p for r in models.score(m, ff.df).select("id", "p").collect()})
    assert out[0] == out[1]
    many = models.dealt(d.repartition(5), models.PARTITION_BYTES, 3)  # as if there were more rows
    assert many.rdd.getNumPartitions() == 24


def test_middling_fits_use_several_partitions(spark):
    """A country of a few hundred thousand households (25 MB) isn't one task; small data is, large goes by bytes."""
    from hearth.plans import models
    d = spark.range(100).withColumn("_draw", F.lit(0))
    parts = {n: models.dealt(d, n, 13).rdd.getNumPartitions() for n in (1, 5_000, 80_000, 232_000, 1_400_000, 10_000_000)}
    assert parts == {1: 1, 5_000: 1, 80_000: 1, 232_000: 3, 1_400_000: 5, 10_000_000: 31}


def test_routed_scores_equal_each_models_own(spark):
    from hearth.plans import models
    from hearth.plans.features import build_features
    from hearth.plans.rates import CategoryRate
    h, i = households(spark, SF_MID), individuals(spark, SF_MID)
    r = standin_recipes()["A"]
    r.sparse = True
    ff = build_features(r, h, i)
    d = models.label_column(ff.df).withColumn("fold", F.when(F.col("_split") == "train", F.col("id") % 2).cast("int"))
    for spec in ({"kind": "gbt", "n_estimators": 2, "max_depth": 2}, {"kind": "linear_svc"}, CategoryRate("c_nationkey")):
        fitted = {f: models.fit_model(d.where(F.col("fold") != f), ff.feature_cols, spec, cat_cols=ff.cat_cols) for f in (0, 1)}
        fitted[None] = models.fit_model(d.where("fold is not null"), ff.feature_cols, spec, cat_cols=ff.cat_cols)
        routed = models.score_routed(fitted, d, F.col("fold"), "s")
        assert set(routed.columns) == {*d.columns, "s"}
        got = {x.id: x.s for x in routed.select("id", "s").collect()}
        for f, m in fitted.items():
            own = models.score(m, d.where("fold is null" if f is None else f"fold = {f}")).select("id", "p").collect()
            assert own and all(abs(got[x.id] - x.p) < 1e-12 for x in own)


def test_stacking_scores_rows_in_one_projection(spark):
    """No join on id between the feature frame and the base models' scores."""
    from hearth.plans import models
    from hearth.plans.features import build_features
    from hearth.session import written
    from tests.test_plans import _plan
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    ff = build_features(standin_recipes()["A"], h, i)
    d = written(models.label_column(ff.df).withColumn("fold", F.when(F.col("_split") == "train", F.col("id") % 2).cast("int")), "t")
    spec = {"kind": "gbt", "n_estimators": 2, "max_depth": 2}
    fitted = {f: models.fit_model(d.where("fold is not null"), ff.feature_cols, spec) for f in (0, 1, None)}
    plan = _plan(models.score_routed(fitted, d, F.col("fold"), "s"))
    assert "Join" not in plan and "Exchange" not in plan


def test_logistic_optimality_is_measured_on_the_rows(spark):
    from hearth.plans import certify, models
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 5 < 2)) for i in range(200)],
                                 "id long, a double, b double, label double")
    m = models.fit_model(rows, ["a", "b"], {"kind": "logistic", "C": 1.0})
    n, g = certify.largest_gradient(m, rows)
    assert n == 200 and g < certify.TOLERANCE
    _, g = certify.largest_gradient(m, rows.where("a > 2"))  # not the rows it was fitted on
    assert g > certify.TOLERANCE
