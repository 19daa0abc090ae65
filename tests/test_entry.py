"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tallyflow.checks import all_checks
from tools.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


QUERIES, SQL = all_checks()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    query, statement = QUERIES[name], SQL[name]
    assert compare(spark, connection, SF_DIR, name, query, statement).startswith("equal")


@pytest.mark.parametrize("name", ["flow_counts_daily", "snapshot_daily", "valid_dates"])
def test_results_do_not_depend_on_the_session_zone(spark, connection, conf, name):
    query, statement = QUERIES[name], SQL[name]
    with conf(spark__sql__session__timeZone="America/New_York"):
        assert compare(spark, connection, SF_DIR, name, query, statement).startswith("equal")


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns[-1] == "flight_count" and result.count() > 0


def test_queries_are_listed_without_a_session():
    """Another process reads the names before any session is there."""
    import subprocess
    import sys

    root = Path(entry_module.__file__).parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 70)"], cwd=root, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr[-500:]
