"""Every registered SQL check, on the smallest tables."""

import pytest

from tabulon.plans.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r["q1"] <= r["q2"] <= r["q3"] for r in rows)


def test_entry_columns(tables):
    from tabulon.plans.queries.base import ENTRY_COLUMNS

    assert tables.entries.dtypes == ENTRY_COLUMNS
