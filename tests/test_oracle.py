"""Every registered query against its SQL twin on the smallest tables."""
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
        return
    _, problem = compare(spark, con, SF, name, sql)
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_registry_loads_without_a_session():
    code = """
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries())
from pyspark.sql import SparkSession
assert SparkSession.getActiveSession() is None"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
