"""Every named query against its SQL statement, on the smallest given tables."""

import datetime as dt
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DIRECTORY = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DIRECTORY.exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in DIRECTORY.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.BASE))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, str(DIRECTORY))
    columns = sorted(df.columns)
    found = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = ordered(tuple(plain(r[i]) for i in places) for r in result.fetchall())
    assert found == wanted


def test_every_query_has_a_check():
    assert set(entry.BASE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
