"""Plan checks: no Python evaluation in core operators, pushdown and pruning
reach the scan, and ranking windows are not single-partition."""

import pytest

from hearth.catalog import REGISTRY
from tests.conftest import SF_SMALL


def _plan(df):
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if not e.heavy and not n.endswith(("_optimality", "_rates", "_cv", "_grid", "_adversarial"))])
def test_no_python_udf(spark, name):
    p = _plan(REGISTRY[name].fn(spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_filter_and_columns_reach_scan(spark):
    p = _plan(REGISTRY["s3_load_indiv_train"].fn(spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double," \
           "o_orderpriority:string>" in p
    assert "o_orderdate" not in p
    from hearth.operators import schema
    from hearth.sources.tables import read_table
    li = read_table(spark, SF_SMALL, "lineitem")
    p = _plan(schema.filter_class(li, "l_returnflag", "R").select("l_orderkey", "l_quantity"))
    assert "EqualTo(l_returnflag,R)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p


def test_count_is_partial_before_shuffle(spark):
    p = _plan(REGISTRY["j1_num_indiv"].fn(spark, SF_SMALL))
    assert "partial_count" in p


def test_fold_window_partitioned_by_bucket(spark):
    p = _plan(REGISTRY["r3_stratified_kfold"].fn(spark, SF_SMALL))
    assert "__b" in p and "Window" in p
