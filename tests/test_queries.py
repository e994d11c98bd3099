"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera import plans

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()
#: Conditions too rare for the smallest tables; they are compared at the next size.
RARE = {"j4_unembedded", "w8_backlog_trend", "c13_stranded", "st3_reconcile", "d3_retired_branches"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, "")
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return (2, round(float(x), 5))
    return (1, str(x))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    place = [found.columns.index(c) for c in df.columns]
    got = sorted(tuple(map(norm, r)) for r in df.collect())
    want = sorted(tuple(norm(r[i]) for i in place) for r in found.fetchall())
    assert got == want
    assert got or name in RARE


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
