"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerline.plans import analytics, corpus, graphs, registry, stores  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(str([norm(x) for x in r]) for r in df.select(*columns).collect())
    if name not in registry.SQL:
        assert rows
        return
    got = duck.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(str([norm(r[names.index(c)]) for c in columns]) for r in got.fetchall())
