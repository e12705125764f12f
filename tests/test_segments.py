"""Running values by segments against plain windows, and one long series in bounded tasks."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.operators import segments as G
from podium.operators import series as S

H = 3_600_000


def some(spark, n=900):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([10, 100]), rnd.choice([rnd.randrange(400), None]), i, rnd.choice([None, float(rnd.randrange(50))])) for i in range(n)]
    return spark.createDataFrame([*rows, (9, 10, 5, n, 1.0)], "contest_id long, tier int, time_ms long, seq long, score double")


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_every_run_equals_its_window(spark, partitions):
    df, keys = some(spark), ["contest_id", "tier"]
    runs = {k: G.Run(k, F.col("score")) for k in ("before", "last", "next", "max", "sum")}
    got = G.scan(df, keys, ["time_ms", "seq"], runs, partitions)
    w = W.partitionBy(*keys).orderBy("time_ms", "seq")
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    want = df.withColumns({"before": F.lag("score").over(w), "last": F.last("score", True).over(up), "next": F.first("score", True).over(down), "max": F.max("score").over(up), "sum": F.sum("score").over(up)})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert G.scan(df.where("false"), keys, ["time_ms"], runs, partitions).count() == 0


def test_operators_give_the_same_rows_either_way(spark):
    df = some(spark).where("contest_id is not null and time_ms is not null and score is not null").withColumn("time_ms", F.col("time_ms") * 60_000)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    for policy in ("zero", "drop"):
        assert rows(S.interval_speed(df, policy)) == rows(S.interval_speed(df, policy, spread=True))
    assert rows(S.cummax_repair(df)) == rows(S.cummax_repair(df, spread=True))
    one = df.groupBy("contest_id", "tier", "time_ms").agg(F.max("score").alias("score")).withColumn("hours", F.col("time_ms") / 60_000.0)
    points = spark.range(0, 420, 7).select(F.col("id").cast("double").alias("hours"), F.lit("p").alias("more")).crossJoin(one.select("contest_id", "tier").distinct())
    assert rows(S.lookup_curve(points, one)) == rows(S.lookup_curve(points, one, spread=True))
    assert rows(S.interpolate_tier_asof(one, 50, 10, 100)) == rows(S.interpolate_tier_asof(one, 50, 10, 100, spread=True))


def test_one_long_series_is_spread_over_tasks(spark):
    n, parts = 400_000, 20
    df = spark.range(n).select(F.lit(1).cast("long").alias("contest_id"), F.lit(10).alias("tier"), (F.col("id") * 1000).alias("time_ms"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 1009).cast("double").alias("score"))
    out = G.scan(df, ["contest_id", "tier"], ["time_ms", "seq"], {"m": G.Run("max", F.col("score")), "b": G.Run("before", F.col("seq"))}, parts)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        sizes = [r[0] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == n and max(sizes) <= n // 2
    assert out.where("not (b <=> nullif(seq, 0) - 1)").count() == 0
    assert out.where("seq >= 1009 and m <> 1008").count() == 0


def test_no_row_reads_the_rest_of_its_series_again(spark):
    """A frame from the current row to the end of a series is evaluated anew for each row: the square of its length."""
    one = spark.createDataFrame([(1, t, 1000 * i, i, float(i)) for i in range(20) for t in (10, 100)], "contest_id long, tier int, time_ms long, seq long, score double").withColumn("hours", F.col("time_ms") / float(H))
    points = one.select("contest_id", "tier", (F.col("hours") + 0.1).alias("hours"))
    for spread in (False, True):
        for df in (S.lookup_curve(points, one, spread=spread), S.interpolate_tier_asof(one, 50, 10, 100, spread=spread)):
            assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().analyzed().toString()


def test_several_values_of_a_curve_at_one_place(spark):
    curve = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 10, 1.0, 20.0), (1, 10, 1.0, 10.0), (1, 10, 2.0, 30.0)], "contest_id long, tier int, hours double, score double")
    points = spark.createDataFrame([(1, 10, x) for x in (0.5, 1.0, 1.5)], "contest_id long, tier int, hours double")
    for spread in (False, True):
        got = S.lookup_curve(points, curve, spread=spread).orderBy("hours").collect()
        assert [r["interpolated"] for r in got] == [5.0, 20.0, 25.0]
