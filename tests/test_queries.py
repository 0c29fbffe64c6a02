"""Registered queries against their oracle SQL in DuckDB, on the smallest tables.

The headline queries run always; set TONEMILL_ALL_QUERIES=1 to run all of them.
"""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from bench import HEADLINE

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()
SELECTED = list(QUERIES) if os.environ.get("TONEMILL_ALL_QUERIES") else HEADLINE

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", SELECTED)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())


def test_entry(spark):
    assert set(driver.entry(spark).columns) == {"domain", "label", "predicted", "n"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
