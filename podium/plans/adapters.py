"""Contest tables made from the general test tables, in Spark and, for the SQL twins, as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.schema import HOUR_MS, TIERS, TRAINING_TIERS

T0, SPAN, LENGTH = 1_704_067_200_000, 259_200_000, 70 * HOUR_MS


def _pick(values, at):
    """The element of a fixed list at a 0-based place."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))



def obs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("points"), "props", F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))
    e = e.withColumns({"contest_id": F.floor((F.col("time_ms") - T0) / SPAN).cast("long"), "tier": _pick(TRAINING_TIERS, F.col("user_id") % 6).cast("int")})
    run = F.sum("points").over(W.partitionBy("contest_id", "tier").orderBy("time_ms", "event_id").rowsBetween(W.unboundedPreceding, 0))
    score = F.greatest(F.lit(0), run - F.when(F.col("event_type") == "error", 2 * F.col("points")).otherwise(0)) / 100.0
    late = F.get_json_object("props", "$.k").cast("long")
    return e.select("contest_id", "tier", "time_ms", score.alias("score"), (F.col("time_ms") + 60_000 * late).alias("available_at"), F.when(F.col("event_id") % 10 == 0, "b").otherwise("a").alias("source"), F.col("event_id").alias("seq"))


def obs_dirty(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).withColumns({"time_ms": F.floor(F.col("time_ms") / HOUR_MS).cast("long") * HOUR_MS, "score": F.when(F.col("seq") % 97 == 0, -1.0).otherwise(F.col("score")), "tier": F.when(F.col("seq") % 101 == 0, 999).otherwise(F.col("tier"))})


def contests(spark: SparkSession, d: str) -> DataFrame:
    c = obs(spark, d).select("contest_id").distinct()
    start = T0 + SPAN * F.col("contest_id")
    return c.select("contest_id", start.alias("start_at"), (start + LENGTH - HOUR_MS * (F.col("contest_id") % 3)).alias("end_at"), (start + LENGTH - HOUR_MS * (F.col("contest_id") % 3)).alias("aggregate_at"), F.when(F.col("contest_id") % 2 == 0, "challenge").otherwise("live_try").alias("contest_type"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("uid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"), F.round(F.col("value") * 100).cast("long").alias("p"))
    e = e.withColumn("contest_id", F.floor((F.col("time_ms") - T0) / SPAN).cast("long"))
    run = F.sum("p").over(W.partitionBy("contest_id", "uid").orderBy("time_ms", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return e.select("contest_id", "uid", "time_ms", (run / 100.0).alias("value"), F.col("event_id").alias("seq"))


def rewards(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    kind = _pick(("voice_stamp", "deco_pins", "item", "degree", "star", "stamp"), F.col("p_partkey") % 6)
    to_rank = _pick(TRAINING_TIERS, F.floor(F.col("p_partkey") / 7) % 6).cast("int")
    return p.select((F.col("p_partkey") % 10).cast("long").alias("contest_id"), kind.alias("reward_type"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey") * 37 % 20011).cast("long").alias("reward_id"), to_rank.alias("to_rank"))


def obs_lineitem(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    tier = _pick(TIERS, F.col("l_suppkey") % 24)
    t = t.select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("contest_id"), tier.cast("int").alias("tier"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("time_ms"), F.col("l_quantity").cast("long").alias("q"), "l_orderkey", "l_linenumber")
    w = W.partitionBy("contest_id", "tier").orderBy("time_ms", "l_orderkey", "l_linenumber").rowsBetween(W.unboundedPreceding, 0)
    return t.select("contest_id", "tier", "time_ms", F.sum("q").over(w).cast("double").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def song_scores(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    tier = _pick(TIERS[1:14], F.col("o_orderkey") % 13)
    return o.select(F.col("o_custkey").alias("song_id"), tier.cast("int").alias("tier"), "o_totalprice").groupBy("song_id", "tier").agg(F.max("o_totalprice").alias("score"))


_T6 = "[50, 100, 300, 500, 1000, 2000]"
_OBS = f"""ev AS (
  SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS pts, props, epoch_us(ts) // 1000 AS time_ms,
    CAST(floor((epoch_us(ts) // 1000 - {T0}) / {SPAN}.0) AS BIGINT) AS contest_id FROM events
), obs AS (
  SELECT contest_id, {_T6}[user_id % 6 + 1] AS tier, time_ms,
    greatest(0, CAST(sum(pts) OVER (PARTITION BY contest_id, {_T6}[user_id % 6 + 1] ORDER BY time_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
      - CASE WHEN event_type = 'error' THEN 2 * pts ELSE 0 END) / 100.0 AS score,
    time_ms + 60000 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS available_at,
    CASE WHEN event_id % 10 = 0 THEN 'b' ELSE 'a' END AS source, event_id AS seq FROM ev
), dirty AS (
  SELECT contest_id, CASE WHEN seq % 101 = 0 THEN 999 ELSE tier END AS tier, time_ms // 3600000 * 3600000 AS time_ms,
    CASE WHEN seq % 97 = 0 THEN -1.0 ELSE score END AS score, available_at, source, seq FROM obs
), contests AS (
  SELECT DISTINCT contest_id, {T0} + {SPAN} * contest_id AS start_at, {T0} + {SPAN} * contest_id + {LENGTH} - 3600000 * (contest_id % 3) AS end_at,
    {T0} + {SPAN} * contest_id + {LENGTH} - 3600000 * (contest_id % 3) AS aggregate_at, CASE WHEN contest_id % 2 = 0 THEN 'challenge' ELSE 'live_try' END AS contest_type FROM obs
), points AS (
  SELECT contest_id, user_id AS uid, time_ms, CAST(sum(pts) OVER (PARTITION BY contest_id, user_id ORDER BY time_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) / 100.0 AS value, event_id AS seq FROM ev
), rewards AS (
  SELECT p_partkey % 10 AS contest_id, ['voice_stamp', 'deco_pins', 'item', 'degree', 'star', 'stamp'][p_partkey % 6 + 1] AS reward_type,
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 37 % 20011 END AS reward_id, {_T6}[p_partkey // 7 % 6 + 1] AS to_rank FROM part
)"""
#: What the classes of speeds and scales need besides.
_SPEED = """, w1 AS (
  SELECT *, greatest(0.0, coalesce((score - lag(score) OVER k) / nullif((time_ms - lag(time_ms) OVER k) / 60000.0, 0), 0)) AS speed
  FROM obs WINDOW k AS (PARTITION BY contest_id, tier ORDER BY time_ms, seq)
), uspeed AS (
  SELECT contest_id, uid, (value - lag(value) OVER k) / nullif((time_ms - lag(time_ms) OVER k) / 60000.0, 0) AS speed
  FROM points WINDOW k AS (PARTITION BY contest_id, uid ORDER BY time_ms, seq)
), scales AS (
  SELECT contest_id, avg(speed) AS scale FROM (
    SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY speed DESC, uid) AS r FROM uspeed WHERE speed > 0 AND speed < 1e6) WHERE r <= 3 GROUP BY contest_id
)"""


def sql(body: str, speed: bool = False, extra: str = "") -> str:
    """A statement over the adapters' tables; extra: further common table expressions, each with a leading comma."""
    return f"WITH RECURSIVE {_OBS}{_SPEED if speed else ''}{extra}\n{body}"
