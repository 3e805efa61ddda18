"""Every registered query against its DuckDB statement, or for rows, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF_DIR = os.environ.get("BALANZA_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        problem = check.compare(df.columns, rows, duck.execute(entry.oracle_sql()[name]))
        assert not problem or problem.startswith("both empty")
