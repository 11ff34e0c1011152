import pytest
from sqlcheck import SF, check

from reelquarry.plans.asset_queries import QUERIES
from reelquarry.plans.asset_sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_is_the_flagship():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
