"""Every registered query with SQL gives the same rows in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    result, _ = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows")), result
    assert not result.endswith(" 0") or name in ("referenced_paths_pages",), "no rows"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
