"""Every registered query next to its SQL twin, on the smallest tables."""

import pytest

from tests.oracle_check import compare, connect
from tidegrid.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, small, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), small) is None


def test_entry_point(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
