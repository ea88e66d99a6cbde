"""Every registered SQL-expressible query equals its DuckDB oracle (sf0.001)."""

import pytest

from hearth.catalog import REGISTRY
from hearth.catalog.oracle import compare, duck
from tests.conftest import SF_SMALL

SQL_ENTRIES = [e for e in REGISTRY.values() if e.sql is not None]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("entry", SQL_ENTRIES, ids=[e.name for e in SQL_ENTRIES])
def test_query_matches_oracle(spark, con, entry):
    ok, msg = compare(spark, con, entry, SF_SMALL)
    assert ok, msg


def test_every_query_has_a_docstring():
    assert all(e.fn.__doc__ for e in REGISTRY.values())


def test_entry_contract():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 80


def test_entry_smoke(spark, monkeypatch):
    """The flagship query with few trees (the models' own number of them takes minutes)."""
    import __spark_entry__ as E
    from hearth.plans import recipes
    for c, model in recipes.REFERENCE_MODELS.items():
        if model["kind"] == "gbt":
            monkeypatch.setitem(recipes.REFERENCE_MODELS, c, {**model, "n_estimators": 4})
    df = E.entry(spark)
    assert df.schema.simpleString() == "struct<id:bigint,country:string,poor:double>"
    rows = df.collect()
    assert len(rows) > 0 and all(0.0 <= r.poor <= 1.0 for r in rows)
