"""The reference's entry-point names work on the test tables."""

from pyspark.sql import functions as F

from hearth import api
from hearth.plans.recipes import standin_recipes
from tests.conftest import SF_SMALL


def test_loaders_and_profiles(spark):
    a, b, c = api.load_hhold_train(spark, SF_SMALL)
    assert a.where(F.col("country") != "A").count() == 0
    ia, ib, ic = api.load_indiv_train(spark, SF_SMALL)
    assert ia.count() + ib.count() + ic.count() == api.load_indiv_train.__globals__["io"].load_indiv(
        spark, SF_SMALL, "train").count()
    assert api.target_ratio(a).count() == 1
    assert "c_mktsegment" in api.select_categorical(a).columns


def test_preprocess_and_enforce(spark):
    a = api.load_hhold_train(spark, SF_SMALL)[0].select("id", "c_mktsegment", "c_nationkey", "_split")
    t = api.load_hhold_test(spark, SF_SMALL)[0].select("id", "c_mktsegment", "c_nationkey", "_split")
    tr = api.pre_process_data(a, categorical="get_dummies")
    te = api.pre_process_data(t, categorical="get_dummies", vocab_from=a, enforce_cols=tr.columns)
    assert te.columns == tr.columns


def test_resample_and_country_model(spark):
    a = api.load_hhold_train(spark, SF_SMALL)[0]
    d = api.resample_data(a, "down")
    c = {r.poor: r["count"] for r in d.groupBy("poor").count().collect()}
    assert c[True] == c[False]
    sub = api.run_b_model(spark, SF_SMALL, standin_recipes({"n_estimators": 3}))
    assert sub.columns == ["id", "country", "poor"]
    ll = spark.createDataFrame([(0.3,), (0.5,)], "log_loss double")
    assert api.mean_log_loss(ll, ll, ll).first()[0] == 0.4


def test_command_line_submit(spark):
    import tempfile
    from hearth.__main__ import main
    from hearth.sources.io import SUBMISSION_SCHEMA, read_csv_table
    out = tempfile.mkdtemp(prefix="hearth-cli-") + "/sub"
    main(["submit", "--data", SF_SMALL, "--out", out, "--trees", "3"])
    sub = read_csv_table(spark, out, SUBMISSION_SCHEMA)
    n_test = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count() - \
        api.load_hhold_train(spark, SF_SMALL)[0].unionByName(api.load_hhold_train(spark, SF_SMALL)[1]) \
        .unionByName(api.load_hhold_train(spark, SF_SMALL)[2]).count()
    assert sub.count() == n_test
    assert sub.where((F.col("poor") < 0) | (F.col("poor") > 1)).count() == 0
