"""Every registered query of the weather-to-energy operators, against its oracle SQL where it has one."""

import pytest

from voltmesh import catalog_queries

from .compare import connect, same

QUERIES, ORACLES = catalog_queries.queries(), catalog_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLES:
        same(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    else:
        assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
