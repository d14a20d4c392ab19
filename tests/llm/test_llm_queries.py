import pytest
from oracle import connect, difference

from sightline.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, data, name):
    assert difference(spark, data, Q.QUERIES[name], Q.ORACLE[name], connect(data)) == ([], [])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).columns
