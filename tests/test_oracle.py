"""Every registered query against its DuckDB oracle (small scale factor)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck

SLOW = {"member_random_forest", "member_bagging", "member_gbt", "member_adaboost", "member_extra_trees",
        "calibrated_members",
        "fitted_ensemble"}
KEYS = sorted(k for k in E.oracle_sql() if k not in SLOW)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[key]).fetchdf()
    assert compare(got, want) is None, compare(got, want)


def test_every_query_has_stable_schema(spark):
    for k, fn in E.queries().items():
        if k in SLOW:
            continue
        assert fn(spark, SF_SMALL).schema is not None


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "pred_binary_HAM" in df.columns
