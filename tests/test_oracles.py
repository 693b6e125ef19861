"""Every registered query with an oracle matches DuckDB exactly (sf0.001)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], ORACLE[name], SF)
    assert r["status"] == "ok", r


def test_every_query_has_callable():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "week" in df.columns
