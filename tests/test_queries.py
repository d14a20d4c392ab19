import pytest
from oracle import connect, difference

from sightline.plans import core_problems, fusion_queries, lexical_queries, state_queries, telemetry_queries

MODULES = (core_problems, lexical_queries, fusion_queries, telemetry_queries, state_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


@pytest.fixture(scope="module")
def connection(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, data, connection, name):
    assert difference(spark, data, QUERIES[name], ORACLE[name], connection) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
