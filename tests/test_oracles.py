"""Every registered query against its SQL twin in DuckDB, over the smallest test tables."""

import math
import os

import duckdb
import pytest

from podium.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "part", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list):
        return str([norm(x) for x in v])
    f = float(v)
    return "nan" if math.isnan(f) else f"{f:.7g}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
