"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.operators import aggregates as G
from podium.operators import clean as C
from podium.plans import adapters as A
from podium.plans.registry import query
from podium.schema import HOUR_MS, TRAINING_TIERS, K

T0 = A.T0


@query("f1_canonicalize_columns", "SELECT contest_id, tier, time_ms, score FROM obs")
def f1(spark, d):
    raw = A.obs(spark, d).select("contest_id", "tier", F.col("score").cast("string").alias("ep"), F.col("time_ms").cast("string").alias("time"))
    return C.canonicalize_columns(raw).select("contest_id", "tier", "time_ms", "score")


@query("f2_validate_tiers", """SELECT CASE WHEN tier IN (1,10,20,30,40,50,100,200,300,400,500,1000,1500,2000,3000,4000,5000,10000,20000,30000,40000,50000,70000,100000) THEN 'kept' ELSE 'rejected' END AS side, tier, count(*) AS n FROM dirty GROUP BY 1, 2""")
def f2(spark, d):
    kept, rest = C.validate_tiers(A.obs_dirty(spark, d))
    return kept.withColumn("side", F.lit("kept")).unionByName(rest.withColumn("side", F.lit("rejected"))).groupBy("side", "tier").agg(F.count("*").alias("n"))


@query("f3_observation_defects", """SELECT contest_id, tier, count(*) AS n, count(*) FILTER (WHERE time_ms < 0) AS invalid_time,
  count(*) FILTER (WHERE score < 0) AS invalid_value FROM dirty GROUP BY ALL""")
def f3(spark, d):
    return C.flag_observation_defects(A.obs_dirty(spark, d)).groupBy(*K).agg(F.count("*").alias("n"), F.count_if("invalid_time").alias("invalid_time"), F.count_if("invalid_value").alias("invalid_value"))


@query("f4_strict_contest_gate", """
, k AS (SELECT d.contest_id, d.tier, max(CAST(score < 0 AS INT)) AS bad, count(*) - count(DISTINCT time_ms) AS dup, max(CAST(time_ms < start_at AS INT)) AS early,
  count(*) FILTER (WHERE time_ms BETWEEN start_at AND end_at) AS inside FROM dirty d JOIN contests USING (contest_id) WHERE d.contest_id % 2 = 0 OR d.seq % 97 <> 0 GROUP BY d.contest_id, d.tier)
SELECT contest_id, list_aggregate(r, 'string_agg', ',') IS NULL AS accepted, coalesce(list_aggregate(r, 'string_agg', ','), '') AS reasons FROM (
  SELECT contest_id, list_sort(list_filter([CASE WHEN max(bad) = 1 THEN 'bad_value' END, CASE WHEN max(CAST(tier = 999 AS INT)) = 1 THEN 'unknown_tier' END, CASE
  WHEN max(dup) > 0 THEN 'duplicate_time' END,
    CASE WHEN max(early) = 1 THEN 'row_before_start' END, CASE WHEN min(inside) < 2 THEN 'too_few_rows' END, CASE
  WHEN count(*) FILTER (WHERE tier IN (50,100,300,500,1000,2000)) < 6 THEN 'missing_training_tier' END], lambda x: x IS NOT NULL)) AS r
  FROM k GROUP BY contest_id)""".replace(", k AS", "WITH k AS", 1))
def f4(spark, d):
    obs = A.obs_dirty(spark, d).where("contest_id % 2 = 0 or seq % 97 <> 0")
    return C.strict_contest_gate(obs, A.contests(spark, d))


@query("f5_as_of_filter", f"""SELECT contest_id, tier, count(*) AS n, max(score) AS top FROM obs
  WHERE time_ms <= {T0} + 259200000 * contest_id + 172800000 AND available_at <= {T0} + 259200000 * contest_id + 172800000 GROUP BY ALL""")
def f5(spark, d):
    origins = A.contests(spark, d).select("contest_id", (F.col("start_at") + 48 * HOUR_MS).alias("origin_ms"))
    return C.as_of_filter(A.obs(spark, d), origins).groupBy(*K).agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("f5_response_level", f"""SELECT contest_id, tier, count(*) AS n, max(score) AS top FROM obs
  WHERE time_ms <= {T0} + 259200000 * contest_id + 172800000 AND tier % 100 = 0 GROUP BY ALL""")
def f5_response(spark, d):
    """One time of availability for a tier's whole response: beyond the origin it empties the tier."""
    origins = A.contests(spark, d).select("contest_id", (F.col("start_at") + 48 * HOUR_MS).alias("origin_ms"))
    late = F.when(F.col("tier") % 100 == 0, 0).otherwise(1).cast("long")
    o = A.obs(spark, d).drop("available_at").join(origins, "contest_id").withColumn("response_at", F.col("origin_ms") + late).drop("origin_ms")
    return C.as_of_filter(o, origins, "response_at").groupBy(*K).agg(F.count("*").alias("n"), F.max("score").alias("top"))


@query("f6_window_class", "SELECT contest_id, CASE WHEN time_ms < start_at THEN 'pre' WHEN time_ms <= end_at THEN 'in' ELSE 'post' END AS \"window\", time_ms > end_at AND time_ms <= end_at + 1200000 AS in_grace, count(*) AS n FROM obs JOIN contests USING (contest_id) GROUP BY ALL")
def f6(spark, d):
    return C.window_class(A.obs(spark, d), A.contests(spark, d)).groupBy("contest_id", "window", "in_grace").agg(F.count("*").alias("n"))


@query("f7_contest_meta", """SELECT contest_id, CASE WHEN contest_id % 4 <> 3 THEN contest_type ELSE 'unknown' END AS contest_type, CASE
  WHEN contest_id % 5 <> 4 THEN start_at END AS start_at, end_at, end_at AS aggregate_at, contest_id % 5 <> 4 AS usable FROM contests""")
def f7(spark, d):
    s = lambda c: F.col(c).cast("string")
    index = A.contests(spark, d).select(
        "contest_id", F.when(F.col("contest_id") % 4 != 3, F.col("contest_type")).alias("eventType"),
        F.array(F.lit("x"), F.lit(None), F.lit("1"), F.when(F.col("contest_id") % 5 != 4, s("start_at")).otherwise("soon")).alias("startAt"), F.array(F.lit("x"), F.lit(None), F.lit("1"), s("end_at")).alias("endAt"))
    return C.contest_meta(index, 3)


@query("f8_current_contest", f"""SELECT n, contest_id FROM (SELECT n, contest_id, row_number() OVER (PARTITION BY n ORDER BY (start_at <= now AND now <= end_at) DESC,
  CASE WHEN start_at <= now AND now <= end_at THEN start_at END DESC NULLS LAST, least(abs(start_at - now), abs(end_at - now)), contest_id) AS r FROM contests,
  (VALUES (1, {T0} + 800000000), (2, {T0} + 255600000), (3, 0)) v(n, now)) WHERE r = 1""")
def f8(spark, d):
    c = A.contests(spark, d)
    at = lambda n, now: C.current_contest(c, now).select(F.lit(n).alias("n"), "contest_id")
    return at(1, T0 + 800_000_000).unionByName(at(2, T0 + 255_600_000)).unionByName(at(3, 0))


@query("f9_ended_contests", f"SELECT contest_id FROM contests WHERE aggregate_at < {T0} + 2000000000 AND contest_type = 'challenge' AND contest_id BETWEEN 1 AND 8 ORDER BY contest_id DESC LIMIT 3")
def f9(spark, d):
    return C.ended_contests(A.contests(spark, d), T0 + 2_000_000_000, ["challenge"], (1, 8), 3).select("contest_id")


@query("f10_is_live", f"SELECT contest_id, {T0} + 1000000000 <= end_at + 1200000 AS live FROM contests")
def f10(spark, d):
    return C.is_live(A.contests(spark, d), T0 + 1_000_000_000).select("contest_id", "live")


@query("f11_corrected_start", """SELECT contest_id, CASE WHEN f > start_at AND f < start_at + 86400000 AND f // 3600000 * 3600000 > start_at THEN f // 3600000 * 3600000
  ELSE start_at END AS start_at FROM contests LEFT JOIN (SELECT contest_id, min(time_ms) AS f FROM obs WHERE score > 400 * (contest_id % 4)
  GROUP BY contest_id) USING (contest_id)""")
def f11(spark, d):
    obs = A.obs(spark, d).where("score > 400 * (contest_id % 4)")
    return C.corrected_start(obs, A.contests(spark, d)).select("contest_id", "start_at")


@query("f12_elapsed_and_phase", """SELECT contest_id, tier, CASE WHEN p < 1/3 THEN 'early' WHEN p < 2/3 THEN 'middle' ELSE 'late' END AS phase, count(*) AS n,
  round(avg(h), 6) AS mean_hours FROM (SELECT contest_id, tier, (time_ms - start_at) / 3600000.0 AS h,
  (time_ms - start_at) / 3600000.0 / ((end_at - start_at) / 3600000.0) AS p FROM obs JOIN contests USING (contest_id)) GROUP BY ALL""")
def f12(spark, d):
    return C.elapsed_and_phase(A.obs(spark, d), A.contests(spark, d)).groupBy(*K, "phase").agg(F.count("*").alias("n"), F.round(F.avg("hours"), 6).alias("mean_hours"))


LOCAL = "make_timestamp((time_ms + 28800000) * 1000)"
DAY_TYPE = f"CASE WHEN isodow({LOCAL}) = 5 AND hour({LOCAL}) >= 17 THEN 'weekend' WHEN isodow({LOCAL}) = 7 AND hour({LOCAL}) >= 23 THEN 'weekday' WHEN isodow({LOCAL}) >= 6 THEN 'weekend' ELSE 'weekday' END"


@query("f13_day_type", f"SELECT {DAY_TYPE} AS day_type, hour({LOCAL}) AS hour, count(*) AS n FROM obs GROUP BY ALL")
def f13(spark, d):
    return C.with_day_type(A.obs(spark, d)).groupBy("day_type", "hour").agg(F.count("*").alias("n"))


_CALENDAR = f"""SELECT CASE WHEN isodow({LOCAL}) = 5 AND hour({LOCAL}) >= 17 THEN 'weekend' WHEN isodow({LOCAL}) = 7 AND hour({LOCAL}) >= 23 THEN 'weekday'
  WHEN day({LOCAL}) % 4 = 0 THEN 'weekday' WHEN day({LOCAL}) % 4 = 1 THEN 'weekend' WHEN isodow({LOCAL}) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour({LOCAL}) AS hour, count(*) AS n FROM obs GROUP BY ALL"""


@query("f13_day_type_by_calendar", _CALENDAR)
def f13_calendar(spark, d):
    """A calendar of the days there are: of each four the first works, the second is free, and the others are not in it."""
    o = A.obs(spark, d)
    days = o.select(F.to_date(C.local_time(F.col("time_ms"))).alias("date")).distinct().where("day(date) % 4 < 2").withColumn("is_workday", F.expr("day(date) % 4 = 0"))
    return C.with_day_type(o, days).groupBy("day_type", "hour").agg(F.count("*").alias("n"))


@query("f15_prefix_gate", f"""
SELECT contest_id, tier, origin_h, reason IS NULL AS valid, reason FROM (
SELECT contest_id, tier, origin_h, CASE WHEN max(CAST(score IS NULL AS INT)) = 1 THEN 'bad_score' WHEN max(CAST(dup AS INT)) = 1 THEN 'duplicate_time'
  WHEN max(CAST(falls AS INT)) = 1 THEN 'decreasing_score' WHEN arg_max(score, time_ms) <= 0 THEN 'no_score' END AS reason
FROM (SELECT o.contest_id, o.tier, o.time_ms, o.score, h.origin_h, coalesce(o.score < lag(o.score) OVER w, false) AS falls, coalesce(o.time_ms = lag(o.time_ms) OVER w, false) AS dup
  FROM obs o CROSS JOIN (VALUES (2), (24), (48)) h(origin_h) WHERE o.time_ms <= {T0} + 259200000 * o.contest_id + 3600000 * h.origin_h
  WINDOW w AS (PARTITION BY o.contest_id, o.tier, h.origin_h ORDER BY o.time_ms, o.score))
GROUP BY contest_id, tier, origin_h)""")
def f15(spark, d):
    c = A.contests(spark, d)
    origins = c.select("contest_id", "start_at", "end_at", F.explode(F.array(F.lit(2), F.lit(24), F.lit(48))).alias("origin_h")).withColumn("origin_ms", F.col("start_at") + HOUR_MS * F.col("origin_h"))
    p = A.obs(spark, d).join(origins, "contest_id").where("time_ms <= origin_ms")
    g = C.prefix_gate(p)
    return g.join(origins.select("contest_id", "origin_ms", "origin_h"), ["contest_id", "origin_ms"]).select(*K, "origin_h", "valid", "reason")


@query("f16_evaluation_gate", f"""
WITH t AS (SELECT DISTINCT contest_id, to_rank AS tier FROM rewards WHERE reward_type = 'deco_pins' AND contest_id <> 5), p AS (SELECT contest_id, tier,
  max(CAST(time_ms > end_at AS INT)) AS post FROM obs JOIN contests USING (contest_id) WHERE tier <> 500 OR contest_id <> 3 GROUP BY ALL)
SELECT c.contest_id, CASE WHEN count(t.tier) = 0 THEN 'not_applicable' WHEN max(end_at) >= {T0} + 2300000000 THEN 'not_completed'
  WHEN count(*) FILTER (WHERE t.tier IS NOT NULL AND p.post IS NULL) > 0 THEN 'reward_tier_without_tracker'
  WHEN count(*) FILTER (WHERE p.post = 0) > 0 THEN 'reward_tier_without_final' ELSE 'evaluable' END AS status
FROM contests c LEFT JOIN t USING (contest_id) LEFT JOIN p ON p.contest_id = t.contest_id AND p.tier = t.tier GROUP BY c.contest_id""")
def f16(spark, d):
    tiers = A.rewards(spark, d).where("reward_type = 'deco_pins' and contest_id <> 5").select("contest_id", F.col("to_rank").alias("tier"))
    return C.evaluation_gate(A.contests(spark, d), A.obs(spark, d).where("tier <> 500 or contest_id <> 3"), tiers, T0 + 2_300_000_000)


@query("f4_reward_provenance", """WITH t AS (SELECT contest_id, list_sort(list_distinct(list(last))) AS tiers, max(n) AS n FROM (
    SELECT contest_id, CASE WHEN reward_id IS NULL THEN reward_type ELSE reward_type || ':' || reward_id END AS k, max(to_rank) AS last, contest_id % 4 AS n FROM rewards
    WHERE reward_type NOT IN ('item', 'practice_ticket', 'star', 'degree', 'bili_degree_effect') GROUP BY ALL) GROUP BY contest_id),
p AS (SELECT c.contest_id, coalesce(CASE WHEN c.contest_id % 3 = 1 THEN list_slice(tiers, 2, 99) ELSE tiers END <> tiers, true) AS differ,
  c.contest_id % 4 = 2 AS foreign_server FROM contests c LEFT JOIN t USING (contest_id))
SELECT contest_id, NOT differ AND NOT foreign_server AS accepted, array_to_string(list_filter([CASE WHEN differ THEN 'reward_tiers_differ' END, CASE
  WHEN foreign_server THEN 'wrong_server' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""")
def f4_provenance(spark, d):
    """Rewards' own tiers, but for a missing one in every third contest and another server in every fourth; the series are sound."""
    c = A.contests(spark, d)
    tiers = G.special_reward_tiers(A.rewards(spark, d)).withColumnRenamed("targets", "reward_tiers")
    tiers = tiers.withColumn("reward_tiers", F.when(F.col("contest_id") % 3 == 1, F.slice("reward_tiers", 2, 99)).otherwise(F.col("reward_tiers")))
    p = c.select("contest_id").join(tiers, "contest_id", "left").withColumn("server", F.when(F.col("contest_id") % 4 == 2, 0).otherwise(3))
    rows = c.select("contest_id", "start_at", F.explode(F.array(*[F.lit(t) for t in TRAINING_TIERS])).alias("tier")).select("contest_id", "tier", F.explode(F.array(F.col("start_at"), F.col("start_at") + 1)).alias("time_ms"), F.lit(1.0).alias("score"))
    return C.strict_contest_gate(rows, c, provenance=p, server=3)


@query("f16_requested_tiers", """SELECT contest_id, CASE WHEN contest_id >= 9 THEN 'not_completed' WHEN contest_id % 2 = 1 OR have <> [50, 100, 300, 500, 1000,
  2000] THEN 'tiers_inconsistent' ELSE 'evaluable' END AS status
FROM contests LEFT JOIN (SELECT contest_id, list_sort(list_distinct(list(tier))) AS have FROM (SELECT contest_id, tier FROM obs UNION ALL SELECT contest_id, 1000
  FROM contests) GROUP BY contest_id) USING (contest_id)""")
def f16_requested(spark, d):
    """Odd contests were to have a tier that nobody collected; each has a final row for the one reward tier."""
    c = A.contests(spark, d)
    final = c.select("contest_id", F.lit(1000).alias("tier"), (F.col("end_at") + 1).alias("time_ms"))
    o = A.obs(spark, d).select("contest_id", "tier", "time_ms").unionByName(final)
    want = c.select("contest_id", F.explode(F.when(F.col("contest_id") % 2 == 1, F.array(*[F.lit(t) for t in (10, *TRAINING_TIERS)])).otherwise(F.array(*[F.lit(t) for t in TRAINING_TIERS]))).alias("tier"))
    now = A.T0 + 9 * A.SPAN
    return C.evaluation_gate(c, o, final.select("contest_id", "tier"), now, want)


@query("parse_local_time", """SELECT contest_id, count(*) AS n, count(*) FILTER (WHERE event_id % 5 <> 4) AS parsed, CAST(sum(CASE WHEN event_id % 5 = 4 THEN 0
  WHEN event_id % 2 = 0 THEN time_ms // 1000 * 1000 ELSE time_ms // 60000 * 60000 END // 1000) AS BIGINT) AS total_s FROM ev GROUP BY contest_id""")
def parse_local(spark, d):
    """Times written at UTC+8, with and without seconds, and every fifth one badly; read back."""
    o = A.obs(spark, d).select("contest_id", "seq", "time_ms")
    shown = F.date_format(C.local_time(F.col("time_ms")), "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("seq") % 5 == 4, F.concat(F.lit("on "), shown)).when(F.col("seq") % 2 == 0, shown).otherwise(F.substring(shown, 1, 16))
    o = o.withColumn("ms", C.parse_local_time(text))
    return o.groupBy("contest_id").agg(F.count("*").alias("n"), F.count("ms").alias("parsed"), F.sum((F.coalesce("ms", F.lit(0)) / 1000).cast("long")).alias("total_s"))
