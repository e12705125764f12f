"""Queries of the readers and writers: the test tables are written as tracker documents and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.plans import adapters as A
from podium.plans.aggregate_queries import NORM, profile
from podium.plans.registry import query
from podium.schema import K
from podium.session import shared_folder
from podium.sources import readers as R


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"


def documents(rows: DataFrame, keys: list[str], doc: Column, path: str) -> str:
    """A file for each key's document; rows has a row for each of them. Gives the files' pattern."""
    rows.select(*keys, doc.alias("value")).repartition(*keys).write.partitionBy(*keys).text(path)
    return path + "/" + "/".join(f"{k}=*" for k in keys) + "/*.txt"


def _of_file(key: str) -> Column:
    return F.regexp_extract("file", rf"{key}=(\d+)", 1).cast("long")


#: One of five servers, the fourth, holds the contest; the others' values are null.
def _by_server(c: str) -> Column:
    null = F.lit(None).cast("string")
    return F.array(null, null, null, F.col(c).cast("string"), null)


@query("s1_read_contest_index", "SELECT contest_id, 3 AS server, contest_type, start_at, end_at, aggregate_at FROM contests")
def s1(spark, d):
    """Even contests by the map form, odd ones by the list form."""
    c, at = A.contests(spark, d), scratch(spark)
    entry = F.struct(F.col("contest_type").alias("eventType"), *[_by_server(x).alias(y) for x, y in (("start_at", "startAt"), ("end_at", "endAt"), ("aggregate_at", "aggregateAt"))])
    wrapped = F.struct(F.lit(True).alias("success"), F.map_from_arrays(F.array(F.col("contest_id").cast("string")), F.array(entry)).alias("data"))
    mapped = documents(c.where("contest_id % 2 = 0"), ["contest_id"], F.to_json(wrapped), f"{at}/map")
    line = F.map_from_arrays(F.array(F.lit("cn")), F.array(F.struct(F.col("start_at").cast("string").alias("startAt"), F.col("end_at").cast("string").alias("endAt"))))
    listed = F.struct(F.array(F.struct(F.col("contest_id").alias("eventId"), F.col("contest_type").alias("eventType"), line.alias("timeline"))).alias("events"))
    other = documents(c.where("contest_id % 2 = 1"), ["contest_id"], F.to_json(listed), f"{at}/list")
    return R.read_contest_index(spark, mapped).unionByName(R.read_contest_index(spark, other)).where("start_at is not null")


@query("s2_read_contest_cache", """SELECT contest_id, tier, count(*) AS n, round(sum(score), 2) AS total, max(available_at) AS last_available, arg_max(score, (time_ms,
  seq)) AS last_score FROM obs GROUP BY ALL""")
def s2(spark, d):
    """A document for each tier of a contest; odd contests have versioned rows."""
    o = A.obs(spark, d)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("time_ms", "seq", "score", "available_at"))), lambda r: F.struct(r["time_ms"].alias("time"), r["score"].alias("ep"), r["available_at"].alias("available_at")))
    g = o.groupBy(*K).agg(rows.alias("rows")).withColumn("m", F.map_from_arrays(F.array(F.col("tier").cast("string")), F.array("rows")))
    odd = F.col("contest_id") % 2 == 1
    doc = F.struct(F.col("contest_id").alias("event_id"), F.when(~odd, F.col("m")).alias("tier_records"), F.when(odd, F.col("m")).alias("tier_record_versions"))
    _, back, _, _ = R.read_contest_cache(spark, documents(g, K, F.to_json(doc), scratch(spark)))
    g = back.groupBy(*K).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"), F.max("available_at").alias("last_available"), F.max_by("score", F.struct("time_ms", "seq")).alias("last_score"))
    return g


_BAD = "CASE contest_id % 5 WHEN 0 THEN 'not_json' WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_json' WHEN 3 THEN 'wrong_type' END"


@query("s2_strict_documents", f"""SELECT contest_id, tier, {_BAD} AS reason, CASE WHEN {_BAD} IS NULL THEN count(*) ELSE 0 END AS n, CASE WHEN {_BAD} IS NULL
  THEN round(sum(score), 2) END AS total FROM obs GROUP BY contest_id, tier""")
def s2_strict(spark, d):
    """Of every five contests one has its documents cut off, one a score that is NaN, one a key twice and one a score that is a word: rejects, with a reason."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("time_ms", "seq", "score"))), lambda r: F.struct(r["time_ms"].alias("time"), r["score"].alias("ep")))
    g = A.obs(spark, d).groupBy(*K).agg(rows.alias("rows")).withColumn("m", F.map_from_arrays(F.array(F.col("tier").cast("string")), F.array("rows")))
    doc = F.to_json(F.struct(F.col("contest_id").alias("event_id"), F.col("m").alias("tier_records")))
    kind, ep = F.col("contest_id") % 5, '"ep":[-0-9.E]+'
    doc = F.when(kind == 0, F.left(doc, (F.length(doc) * 0.7).cast("int"))).when(kind == 1, F.regexp_replace(doc, ep + "\\}\\]", '"ep":NaN}]')).when(kind == 2, F.regexp_replace(doc, "^\\{", '{"event_id":1,')).when(
        kind == 3, F.regexp_replace(doc, ep + "\\}\\]", '"ep":"many"}]')).otherwise(doc)
    _, back, _, bad = R.read_contest_cache(spark, documents(g, K, doc, scratch(spark)))
    ok = back.groupBy(*K).agg(F.lit(None).cast("string").alias("reason"), F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))
    names = [_of_file("contest_id").alias("contest_id"), _of_file("tier").cast("int").alias("tier")]
    return ok.unionByName(bad.select(*names, "reason", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total")))


@query("s3_read_tracker_payload", """SELECT contest_id, tier, CASE WHEN contest_id % 4 = 3 THEN 'result_not_true' WHEN contest_id % 4 = 2 AND tier = 50 THEN 'empty' END AS reason,
  CASE WHEN contest_id % 4 = 3 OR contest_id % 4 = 2 AND tier = 50 THEN 0 ELSE count(*) END AS n, CASE
  WHEN NOT (contest_id % 4 = 3 OR contest_id % 4 = 2 AND tier = 50) THEN round(sum(score), 2) END AS total FROM obs GROUP BY contest_id, tier""")
def s3(spark, d):
    """Every fourth contest's payloads failed, and some are empty: those come back as rejects."""
    g = A.obs(spark, d).groupBy(*K).agg(F.collect_list(F.struct(F.col("time_ms").alias("time"), F.col("score").alias("ep"))).alias("rows"))
    cutoffs = F.when((F.col("contest_id") % 4 == 2) & (F.col("tier") == 50), F.slice("rows", 1, 0)).otherwise(F.col("rows"))
    doc = F.struct((F.col("contest_id") % 4 != 3).alias("result"), cutoffs.alias("cutoffs"))
    rows, bad = R.read_tracker_payload(spark, documents(g, K, F.to_json(doc), scratch(spark)))
    names = [_of_file("contest_id").alias("contest_id"), _of_file("tier").cast("int").alias("tier")]
    ok = rows.select(*names, "score").groupBy(*K).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total")).withColumn("reason", F.lit(None).cast("string"))
    return ok.unionByName(bad.select(*names, F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total"), "reason"))


@query("s4_read_player_points", "SELECT contest_id, count(*) AS n, count(DISTINCT uid) AS players, max(time_ms) AS last_ms, round(sum(value), 2) AS total FROM points GROUP BY contest_id")
def s4(spark, d):
    """A document for each sixteenth of a contest's players."""
    p = A.points(spark, d).withColumn("part", F.col("uid") % 16)
    g = p.groupBy("contest_id", "part").agg(F.collect_list(F.struct("uid", F.col("time_ms").alias("time"), "value")).alias("points"))
    back, _ = R.read_player_points(spark, documents(g, ["contest_id", "part"], F.to_json(F.struct("points")), scratch(spark)))
    return back.groupBy(_of_file("contest_id").alias("contest_id")).agg(F.count("*").alias("n"), F.count_distinct("uid").alias("players"), F.max("time_ms").alias("last_ms"), F.round(F.sum("value"), 2).alias("total"))


@query("s5_read_rewards", """SELECT contest_id, reward_type, count(*) AS n, count(reward_id) AS with_id, CAST(sum(to_rank) AS BIGINT) AS ranks FROM rewards
  WHERE contest_id % 5 <> 4 GROUP BY ALL UNION ALL SELECT DISTINCT contest_id, 'no_rewards', 0, 0, 0 FROM rewards WHERE contest_id % 5 = 4""")
def s5(spark, d):
    """The second of two servers; every fifth contest has none there, and is a reject."""
    one = F.struct(F.col("to_rank").alias("toRank"), F.col("reward_type").alias("rewardType"), F.col("reward_id").alias("rewardId"))
    g = A.rewards(spark, d).groupBy("contest_id").agg(F.collect_list(one).alias("r"))
    none = F.slice("r", 1, 0)
    doc = F.struct(F.col("contest_id").alias("eventId"), F.array(none, F.when(F.col("contest_id") % 5 == 4, none).otherwise(F.col("r"))).alias("rankingRewards"))
    rows, bad = R.read_rewards(spark, documents(g, ["contest_id"], F.to_json(doc), scratch(spark)), 1)
    ok = rows.groupBy("contest_id", "reward_type").agg(F.count("*").alias("n"), F.count("reward_id").alias("with_id"), F.sum("to_rank").alias("ranks"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n", "with_id", "ranks")]
    return ok.unionByName(bad.select(_of_file("contest_id").alias("contest_id"), F.col("reason").alias("reward_type"), *zero))


@query("s6_hour_profile_round_trip", "SELECT day_type, hr AS hour, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, cnt FROM prof", speed=True, extra=NORM)
def s6(spark, d):
    at = scratch(spark)
    R.write_hour_profile(profile(spark, d), at)
    return R.read_hour_profile(spark, at).select("day_type", F.col("hour").cast("long").alias("hour"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "cnt")


@query("s7_write_observations", "SELECT contest_id, tier, count(*) AS n, round(sum(CASE WHEN contest_id < 4 THEN score + 1 ELSE score END), 2) AS total FROM obs GROUP BY ALL")
def s7(spark, d):
    """All contests are written, then the buckets of the first four again, with other scores; the rest stays."""
    o, at = A.obs(spark, d), scratch(spark)
    R.write_observations(o, at, 2)
    R.write_observations(o.where("contest_id < 4").withColumn("score", F.col("score") + 1), at, 2)
    return spark.read.parquet(at).groupBy(*K).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("s8_write_report", "SELECT contest_id, contest_type, start_at, end_at FROM contests")
def s8(spark, d):
    at = scratch(spark)
    R.write_report(A.contests(spark, d), at)
    return spark.read.schema("contest_id long, contest_type string, start_at long, end_at long").json(at)
