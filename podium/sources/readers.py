"""Reading of tracker documents and writing of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.clean import SCORE_NAMES
from podium.schema import DEFAULTS

_TIMES = "ARRAY<STRING>"
#: Servers in the order of the arrays.
SERVERS = ("jp", "tw", "en", "cn", "kr")
_INDEX = f"eventType STRING, startAt {_TIMES}, endAt {_TIMES}, aggregateAt {_TIMES}, aggregateEndAt {_TIMES}"
_ROW = "STRUCT<time: BIGINT, timestamp: BIGINT, " + ", ".join(f"{c}: DOUBLE" for c in SCORE_NAMES) + ", available_at: BIGINT, source: STRING>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text, with their names: documents are small, and their shape is dynamic at the edge."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.input_file_name().alias("file"))


def _strict(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(d, file) of the documents that are what they should be, and (file, reason) of the others.

    not_json: nothing, a cut-off document, other text behind it, a constant that is not finite, or a key twice in an
    object; wrong_type: a value that its column's type does not hold. Nothing of a rejected document is read. Files
    without a byte are no documents, Spark does not open them.
    """
    d = _documents(spark, path).withColumn("j", F.from_json("doc", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"}))
    # parsers stop behind the first value: what stands alone, in a list and in an object alike, has nothing behind it
    alone = [F.try_parse_json(F.concat(F.lit(a), F.col("doc"), F.lit(b))).isNull() for a, b in (("[", "]"), ('{"a":', "}"))]
    reason = F.when(alone[0] | alone[1] | F.col("j").isNull(), "not_json").when(F.col("j._corrupt").isNotNull(), "wrong_type")
    d = d.select("file", F.col("j").alias("d"), reason.alias("reason"))
    return d.where("reason is null").select("d", "file"), d.where("reason is not null").select("file", "reason")


def read_contest_index(spark: SparkSession, path: str) -> DataFrame:
    """(contest_id, server, contest_type, start_at, end_at, aggregate_at): a row for each contest and server.

    Two forms, bare or wrapped in {success, data}: a map from id to an object with arrays by server, and a
    list under events with a timeline by server name. Values that do not cast are null.
    """
    d = _documents(spark, path).select(F.coalesce(F.get_json_object("doc", "$.data"), "doc").alias("j"))
    listed = F.from_json(F.get_json_object("j", "$.events"), "ARRAY<STRUCT<eventId: BIGINT, eventType: STRING, timeline: MAP<STRING, STRUCT<startAt: STRING, endAt: STRING>>>>")
    as_list = d.where(F.get_json_object("j", "$.events").isNotNull()).select(F.explode(listed).alias("e"))
    as_list = as_list.select("e.eventId", "e.eventType", F.explode("e.timeline").alias("name", "t"))
    as_list = as_list.select(F.col("eventId").alias("contest_id"), (F.array_position(F.array(*[F.lit(s) for s in SERVERS]), F.col("name")) - 1).cast("int").alias("server"), F.col("eventType").alias("contest_type"), F.col("t.startAt").alias("s"), F.col("t.endAt").alias("e"), F.lit(None).cast("string").alias("a"))
    mapped = d.where(F.get_json_object("j", "$.events").isNull()).select(F.explode(F.from_json("j", f"MAP<STRING, STRUCT<{_INDEX.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>")).alias("id", "v"))
    mapped = mapped.select(F.col("id").try_cast("long").alias("contest_id"), "v.*").select("*", F.posexplode("startAt").alias("server", "s"))
    at = lambda c: F.get(F.col(c), F.col("server"))
    mapped = mapped.select("contest_id", "server", F.col("eventType").alias("contest_type"), "s", at("endAt").alias("e"), F.coalesce(at("aggregateAt"), at("aggregateEndAt")).alias("a"))
    rows = mapped.unionByName(as_list).where("contest_id is not null and server >= 0")
    end = F.col("e").try_cast("long")
    return rows.select("contest_id", "server", F.coalesce("contest_type", F.lit("unknown")).alias("contest_type"), F.col("s").try_cast("long").alias("start_at"), end.alias("end_at"), F.coalesce(F.col("a").try_cast("long"), end).alias("aggregate_at"))


def read_contest_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(contests, observations, reward tiers, rejects) of cache documents, one contest each. Versioned rows are taken where there are any; documents that cannot be trusted are rejects, with a reason."""
    schema = f"event_id BIGINT, meta STRUCT<start_at: BIGINT, end_at: BIGINT, event_type: STRING>, reward_tiers ARRAY<INT>, reward_tier_provenance STRUCT<source: STRING, server: STRING, last_appearance: MAP<STRING, INT>>, tier_records MAP<STRING, ARRAY<{_ROW}>>, tier_record_versions MAP<STRING, ARRAY<{_ROW}>>"
    d, rejects = _strict(spark, path, schema)
    d = d.select("d.*", "file")
    rejects = rejects.unionByName(d.where("event_id is null").select("file", F.lit("no_id").alias("reason")))
    d = d.where("event_id is not null")
    contests = d.select(F.col("event_id").alias("contest_id"), "meta.start_at", "meta.end_at", F.col("meta.event_type").alias("contest_type"), "file")
    records = F.when(F.coalesce(F.size("tier_record_versions"), F.lit(0)) > 0, F.col("tier_record_versions")).otherwise(F.col("tier_records"))
    rows = d.select(F.col("event_id").alias("contest_id"), F.explode(records).alias("tier", "rows")).select("contest_id", F.col("tier").try_cast("int").alias("tier"), F.posexplode("rows").alias("seq", "r"))
    obs = rows.select("contest_id", "tier", F.coalesce("r.time", "r.timestamp").alias("time_ms"), F.coalesce(*[F.col(f"r.{c}") for c in SCORE_NAMES]).alias("score"), "r.available_at", "r.source", F.col("seq").cast("long").alias("seq"))
    rewards = d.select(F.col("event_id").alias("contest_id"), "reward_tiers", "reward_tier_provenance.last_appearance")
    return contests, obs, rewards, rejects


def read_tracker_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): (file, time_ms, score) of payloads {result, cutoffs}; files that failed, are empty or lack columns, with a reason."""
    d, broken = _strict(spark, path, f"result BOOLEAN, cutoffs ARRAY<{_ROW}>")
    d = d.select("file", "d.*")
    t, s = F.coalesce("c.time", "c.timestamp"), F.coalesce(*[F.col(f"c.{x}") for x in SCORE_NAMES])
    first = d.withColumn("c", F.get("cutoffs", F.lit(0)))
    reason = F.when(~F.coalesce("result", F.lit(False)), "result_not_true").when(F.coalesce(F.size("cutoffs"), F.lit(0)) <= 0, "empty").when(t.isNull(), "no_time").when(s.isNull(), "no_score")
    first = first.withColumn("reason", reason)
    rows = first.where("reason is null").select("file", F.explode("cutoffs").alias("c")).select("file", t.alias("time_ms"), s.alias("score"))
    return rows, first.where("reason is not null").select("file", "reason").unionByName(broken)


def read_player_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, rejects): (file, uid, time_ms, value, seq) of {points: [{uid, time, value}]}; files that cannot be trusted or have no points, with a reason."""
    d, broken = _strict(spark, path, "points ARRAY<STRUCT<uid: BIGINT, time: BIGINT, value: DOUBLE>>")
    none = d.where(F.coalesce(F.size("d.points"), F.lit(0)) <= 0).select("file", F.lit("empty").alias("reason"))
    rows = d.select("file", F.posexplode("d.points").alias("seq", "p")).select("file", "p.uid", F.col("p.time").alias("time_ms"), "p.value", F.col("seq").cast("long").alias("seq"))
    return rows, broken.unionByName(none)


def read_rewards(spark: SparkSession, path: str, server: int) -> tuple[DataFrame, DataFrame]:
    """(rewards, rejects): one server's ranking rewards; files without any, with a reason."""
    d, broken = _strict(spark, path, "eventId BIGINT, rankingRewards ARRAY<ARRAY<STRUCT<toRank: INT, rewardType: STRING, rewardId: BIGINT>>>")
    d = d.select("file", "d.eventId", F.get("d.rankingRewards", F.lit(server)).alias("r"))
    rows = d.select(F.col("eventId").alias("contest_id"), F.explode("r").alias("r")).select("contest_id", F.col("r.rewardType").alias("reward_type"), F.col("r.rewardId").alias("reward_id"), F.col("r.toRank").alias("to_rank"))
    return rows, d.where(F.coalesce(F.size("r"), F.lit(0)) <= 0).select("file", F.lit("no_rewards").alias("reason")).unionByName(broken)


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(file, params map): a preset's params over the defaults; values that are no numbers stay defaults."""
    base = F.map_from_arrays(F.array(*[F.lit(k) for k in DEFAULTS]), F.array(*[F.lit(float(v)) for v in DEFAULTS.values()]))
    own = F.coalesce(F.from_json(F.get_json_object("doc", "$.params"), "MAP<STRING, STRING>"), F.from_json(F.lit("{}"), "MAP<STRING, STRING>"))
    own = F.map_filter(F.transform_values(own, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
    return _documents(spark, path).select("file", F.map_concat(rest, own).alias("params"))


def preset(spark: SparkSession, path: str) -> dict[str, float]:
    """The settings of one preset file, as operators take them."""
    return dict(read_presets(spark, path).first()["params"])


def read_hour_profile(spark: SparkSession, path: str) -> DataFrame:
    """(day_type, hour, mean, median, std, cnt) of a nested profile {day type: {hour: stats or null}}."""
    d = _documents(spark, path).select(F.explode(F.from_json("doc", "MAP<STRING, MAP<STRING, STRUCT<mean: DOUBLE, median: DOUBLE, std: DOUBLE, count: BIGINT>>>")).alias("day_type", "hours"))
    return d.select("day_type", F.explode("hours").alias("hour", "s")).select("day_type", F.col("hour").cast("int").alias("hour"), "s.mean", "s.median", "s.std", F.coalesce("s.count", F.lit(0)).alias("cnt"))


def write_hour_profile(profile: DataFrame, path: str) -> None:
    """The inverse of read_hour_profile: 48 rows to one JSON document."""
    stats = F.when(F.col("cnt") > 0, F.struct("mean", "median", "std", F.col("cnt").alias("count")))
    one = profile.groupBy("day_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("hour").cast("string"), stats))).alias("h"))
    one.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("day_type", "h"))), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_observations(obs: DataFrame, path: str, contests_per_bucket: int = 64) -> None:
    """Parquet by contest bucket; buckets that are rewritten are replaced as a whole, the others stay."""
    rows = obs.withColumn("bucket", F.floor(F.col("contest_id") / contests_per_bucket))
    rows.repartition("bucket", "contest_id").sortWithinPartitions("bucket", "contest_id", "tier", "time_ms").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_report(report: DataFrame, path: str, form: str = "json") -> None:
    report.write.mode("overwrite").format(form).save(path)
