"""Queries of the subpackage that SQL can express, against their SQL."""

import pytest

from fieldloom.llm.queries import ORACLE_SQL, QUERIES
from tests.harness import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
