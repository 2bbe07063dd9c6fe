"""Every contract query at the smallest scale: against its oracle, or at least rows."""

import pytest
from check_contract import compare
from conftest import SF_DIR

import __spark_entry__ as entry_module


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, name):
    line, good = compare(spark, SF_DIR, name)
    assert good, line


def test_entry(spark):
    found = entry_module.entry(spark)
    assert found.columns[0] == "grid_index"
    assert found.filter("is_best").count() == 1


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
