"""Every log query against its DuckDB SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidewatch.plans import more_queries  # noqa: F401
from tidewatch.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    want = duck.sql(ORACLES[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)
