"""Queries of the live operators: streams over the stored rows, in several micro-batches, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.plans import adapters as A
from podium.plans.model_queries import kalman_steps
from podium.plans.registry import ORACLES, query
from podium.plans.source_queries import scratch
from podium.schema import HOUR_MS, K
from podium.session import cut
from podium.streaming import live as L
from podium.streaming import store as S

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def streamed(spark: SparkSession, rows: DataFrame, order: str, files: int = 3) -> DataFrame:
    """rows as a stream of `files` micro-batches, in the order of a column: ranges are written one after the other, as files arrive."""
    at = scratch(spark)
    ranges = cut(rows.repartitionByRange(files, order).withColumn("range", F.spark_partition_id()))
    for k in range(files):
        ranges.where(F.col("range") == k).drop("range").write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def into(stream: DataFrame, write, mode: str = "append", at: str | None = None) -> None:
    """Runs a stream until all has arrived, each micro-batch through write(rows, batch)."""
    spark = stream.sparkSession
    at, before = at or scratch(spark), spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def arrived(spark: SparkSession, stream: DataFrame, mode: str = "append", parts: list[str] | None = None) -> DataFrame:
    """What a stream has written once all has arrived, with `batch`, the micro-batch of each row; parts: columns that the sink parts rows by."""
    at = scratch(spark)

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy(*parts or []).parquet(f"{at}/out/n={batch}")  # a batch that is run again replaces itself

    into(stream, write, mode, at)
    return spark.read.parquet(f"{at}/out").drop("n")


@query("st1_merge_versions", "SELECT contest_id, tier, time_ms, score, min(available_at) AS available_at FROM dirty GROUP BY ALL")
def st1(spark, d):
    o = A.obs_dirty(spark, d)
    return L.merge_versions(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"), 0)


@query("st2_latest_view", "SELECT contest_id, tier, time_ms, arg_max(score, (available_at, seq)) AS score FROM dirty GROUP BY ALL")
def st2(spark, d):
    return L.latest_view(A.obs_dirty(spark, d))


@query("st3_late_policy", "SELECT contest_id, time_ms <= end_at + 1200000 AS accepted, count(*) AS n FROM obs JOIN contests USING (contest_id) GROUP BY ALL")
def st3(spark, d):
    ok, late = L.late_policy(A.obs(spark, d), A.contests(spark, d))
    return ok.withColumn("accepted", F.lit(True)).unionByName(late.withColumn("accepted", F.lit(False))).groupBy("contest_id", "accepted").agg(F.count("*").alias("n"))


@query("st5_live_speed_windows", """SELECT contest_id, tier, time_ms // 21600000 * 21600000 AS window_ms, round(arg_max(score, (time_ms, seq)) - arg_min(score, (time_ms,
  seq)), 2) AS gain FROM obs GROUP BY contest_id, tier, time_ms // 21600000""")
def st5(spark, d):
    g = L.live_speed_windows(A.obs(spark, d).withColumn("ts", F.timestamp_millis("time_ms")))
    return g.select(*K, F.unix_millis("window.start").alias("window_ms"), F.round("gain", 2).alias("gain"))


#: When four fetches of everything are made: the second is within the delay of the first, the fourth beyond it.
FETCHED = (0, 10, 120, 240)


@query("st1_first_seen_stream", f"""SELECT contest_id, tier, time_ms, count(*) AS n, 2 * count(*) AS passed, {A.T0} AS first_seen FROM (SELECT DISTINCT contest_id, tier,
  time_ms, score FROM dirty) GROUP BY ALL""")
def st1_stream(spark, d):
    """All rows are fetched four times: an identity passes again when it comes after the 20 minutes, and the store keeps its first time."""
    o = A.obs_dirty(spark, d).select(*K, "time_ms", "score")
    minute = F.explode(F.array(*map(F.lit, FETCHED)))
    rows = o.withColumn("minute", minute).withColumn("available_at", F.lit(A.T0) + F.col("minute") * 60_000).withColumn("ts", F.timestamp_millis("available_at"))
    at, n = scratch(spark), scratch(spark)

    def put(df, batch):
        df = df.persist()
        S.add_versions(spark, at, batch, df)
        df.groupBy(*K, "time_ms").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{n}/{batch}")
        df.unpersist()

    into(L.first_seen_versions(streamed(spark, rows, "minute", len(FETCHED))), put)
    passed = spark.read.parquet(f"{n}/*").groupBy(*K, "time_ms").agg(F.sum("n").alias("passed"))
    stored = S.versions(spark, at).groupBy(*K, "time_ms").agg(F.count("*").alias("n"), F.max("available_at").alias("first_seen"))
    return stored.join(passed, [*K, "time_ms"]).select(*K, "time_ms", "n", "passed", "first_seen")


@query("st1_versions_stored", "SELECT contest_id, tier, time_ms, score, min(available_at) AS available_at FROM dirty GROUP BY ALL")
def st1_stored(spark, d):
    """Fetches in the order of arrival, each merged into the buckets that it changes."""
    at = scratch(spark)
    into(streamed(spark, A.obs_dirty(spark, d), "seq"), lambda df, batch: S.add_versions(spark, at, batch, df))
    return S.versions(spark, at)


@query("st2_latest_view_stream", "SELECT contest_id, tier, time_ms, arg_max(score, (available_at, seq)) AS score FROM dirty GROUP BY ALL")
def st2_stream(spark, d):
    """The stored view as it lies there; every micro-batch is written twice, as after a failure."""
    at = scratch(spark)

    def put(df, batch):
        for _ in range(2):
            S.upsert_latest(spark, at, batch, df)

    into(streamed(spark, A.obs_dirty(spark, d), "seq"), put)
    return S.latest(spark, at)


@query("st3_late_policy_stream", "SELECT contest_id, time_ms <= end_at + 1200000 AS accepted, count(*) AS n FROM obs JOIN contests USING (contest_id) GROUP BY ALL")
def st3_stream(spark, d):
    """Three micro-batches in the order of availability; accepted rows and late ones part in one pass of the sink."""
    rows = A.obs(spark, d).withColumn("ts", F.timestamp_millis("available_at"))
    out = arrived(spark, L.late_split(streamed(spark, rows, "available_at"), A.contests(spark, d)), parts=["accepted"])
    return out.groupBy("contest_id", F.col("accepted").cast("boolean").alias("accepted")).agg(F.count("*").alias("n"))


#: In three micro-batches: every fiftieth row of the first comes with the third.
_ARRIVAL = f"""WITH r AS (SELECT *, (time_ms - {A.T0}) * 3 // (SELECT max(time_ms) - {A.T0} + 1 FROM obs) AS third FROM obs),
b AS (SELECT *, CASE WHEN third = 0 AND seq % 50 = 0 THEN 2 ELSE third END AS batch, time_ms // 21600000 * 21600000 AS window_ms FROM r)
SELECT contest_id, tier, window_ms, round(arg_max(score, (time_ms, seq)) - arg_min(score, (time_ms, seq)), 2) AS gain FROM b
WHERE NOT (batch = 2 AND window_ms + 21600000 <= (SELECT max(time_ms) FROM b WHERE batch = 0) - 1200000) AND window_ms + 21600000 <= (SELECT max(time_ms) FROM b) - 1200000 GROUP BY ALL"""


@query("st5_closed_windows_stream", _ARRIVAL)
def st5_stream(spark, d):
    """Windows that close in append mode: rows for a window that has closed are too late, those for an open one count."""
    o = A.obs(spark, d)
    top = cut(o.agg(F.max("time_ms").alias("top")))
    third = F.floor((F.col("time_ms") - A.T0) * 3 / (F.col("top") - A.T0 + 1))
    rows = o.crossJoin(F.broadcast(top))  # one row
    rows = rows.withColumn("arrival", F.when((third == 0) & (F.col("seq") % 50 == 0), 2).otherwise(third)).drop("top").withColumn("ts", F.timestamp_millis("time_ms"))
    g = arrived(spark, L.live_speed_windows(streamed(spark, rows, "arrival")))
    return g.select(*K, F.unix_millis("window.start").alias("window_ms"), F.round("gain", 2).alias("gain"))


#: Points within 20 minutes of a contest's end; later ones are not looked at.
@query("st4_live_scale", """WITH ok AS (SELECT points.* FROM points JOIN contests USING (contest_id) WHERE time_ms <= end_at + 1200000), u AS (SELECT contest_id, uid,
  (value - lag(value) OVER k) / nullif((time_ms - lag(time_ms) OVER k) / 60000.0, 0) AS speed FROM ok WINDOW k AS (PARTITION BY contest_id, uid ORDER BY time_ms, seq)
), r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY speed DESC) AS r FROM u WHERE speed > 0 AND speed < 1e6)
SELECT contest_id, round(avg(speed), 6) AS scale FROM r WHERE r <= 3 GROUP BY contest_id""")
def st4(spark, d):
    """The newest row of each contest in the sink is its scale."""
    out = arrived(spark, L.live_scale(streamed(spark, A.points(spark, d), "time_ms"), A.contests(spark, d)))
    return out.groupBy("contest_id").agg(F.round(F.max_by("scale", "batch"), 6).alias("scale"))


@query("st6_live_strength")
def st6(spark, d):
    """The state after each micro-batch; the last one of a series is its strength."""
    start = A.contests(spark, d).select("contest_id", "start_at")
    steps = kalman_steps(spark, d).join(start, "contest_id").withColumn("time_ms", F.col("start_at") + F.col("step") * HOUR_MS).drop("start_at")
    out = arrived(spark, L.live_strength_state(streamed(spark, steps, "step"), A.contests(spark, d), delay="400 days"), "update")
    last = out.groupBy(*K).agg(F.max_by(F.struct("scale", "trend"), "step").alias("x"))
    return last.select(*K, F.round("x.scale", 6).alias("scale"), F.round("x.trend", 6).alias("trend"))


ORACLES["st6_live_strength"] = ORACLES["m11_kalman_strength"]
