import pytest

from blockwright.plans.more import ALL_SQL as SQL
from blockwright.plans.queries import QUERIES

from compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
