"""Every registered query of the archive operators against its oracle, on the smallest tables."""

import pytest

from tests.compare import assert_equal, connect
from threadlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    assert_equal(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


def test_every_query_has_an_oracle_or_is_known():
    assert set(registry.QUERIES) - set(registry.ORACLES) <= set(registry.ROWS_ONLY)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
