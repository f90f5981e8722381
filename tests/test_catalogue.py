"""Every query with SQL gives the same rows in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from skyweave.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(rows):
    return sorted([tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    got, want = norm(tuple(r[c] for c in cols) for r in df.collect()), norm(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


def test_queries_without_sql(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0
