"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from fieldloom.plans.catalog import ORACLE_SQL, QUERIES

from .harness import connect, differences


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert not differences(QUERIES[name](spark, sf_dir), db, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
