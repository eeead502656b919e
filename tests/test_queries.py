"""Every query runs over the smallest tables and has rows; those with a DuckDB twin agree with it."""

import pytest

from epiframe.catalog import ORACLES, QUERIES
from tests.conftest import FOLDER
from verify import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).collect()


def test_flagship(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert rows and set(entry.oracle_sql()) <= set(entry.queries())
