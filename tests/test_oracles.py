"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from tradewind.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert sorted(tuple(map(shown, r)) for r in df.select(*columns).collect()) == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
