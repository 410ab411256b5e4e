"""Every registered query runs; those with SQL give the same rows as DuckDB at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in sorted(FOLDER.glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, str(FOLDER))
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    result = db.execute(sql)
    assert got == rows_of([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
