"""Every query with SQL against DuckDB on the smallest tables."""

import compare
import pytest

from strataplane.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, con, name):
    assert compare.differences(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE[name]) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
