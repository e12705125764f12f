"""Rows of one series and time: queries keep them as their SQL does."""

import duckdb
import pytest

from podium.catalog import ORACLES, QUERIES

from .test_oracles import SF, norm, pytestmark  # noqa: F401


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The small tables; some events come with another at their time, within a contest and around its end."""
    d = tmp_path_factory.mktemp("repeated")
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{SF}/part.parquet'")
    c.sql(f"copy part to '{d}/part.parquet' (format parquet)")
    # scores stay as they are, so the order of equal times, which the SQL leaves open, does not matter
    again = "select event_id + 1000000 as event_id, ts, user_id, event_type, 0.0 as value, props from e where event_type <> 'error' and (event_id % 37 = 5 or epoch_us(ts) // 1000 % 259200000 between 237600000 and 253200000)"
    c.sql(f"copy (with e as (select * from '{SF}/events.parquet') select * from e union all {again}) to '{d}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{d}/events.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["m1_pace_components", "m3_excluded_contests", "m7_excluded_series", "w4_canonical_training_series", "w5_history_series"])
def test_query_equals_sql_with_repeated_times(spark, repeated, name):
    d, duck = repeated
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
