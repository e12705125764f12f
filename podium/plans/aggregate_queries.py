"""Queries of scales, profiles, strength, rewards, quality and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.operators import aggregates as G
from podium.operators import clean as C
from podium.operators import joins as J
from podium.operators import series as S
from podium.operators.moments import window_statistics
from podium.plans import adapters as A
from podium.plans.clean_queries import DAY_TYPE, LOCAL
from podium.plans.registry import query
from podium.plans.series_queries import scales
from podium.schema import HOUR_MS, TRAINING_TIERS, K
from podium.session import cut

T0 = A.T0


def normalised(spark, d):
    """Speeds of the test contests, normalised, with hours."""
    rows = C.elapsed_and_phase(A.obs(spark, d), A.contests(spark, d))
    return S.attach_scale(S.interval_speed(rows), scales(spark, d))


def profile(spark, d):
    return G.hourly_speed_profile(normalised(spark, d).where("norm_speed <= 1.2"))


def skeletons(spark, d):
    n = cut(normalised(spark, d))
    return cut(G.attach_season_factor(n, G.season_factors(G.hourly_speed_profile(n.where("norm_speed <= 1.2"), exact=False))))  # factors need no medians


NORM = f""", nrm AS (SELECT w1.*, start_at, end_at, (time_ms - start_at) / 3600000.0 AS hours, scale, speed / scale AS norm_speed, {DAY_TYPE} AS day_type,
  hour({LOCAL}) AS hr FROM w1 JOIN contests USING (contest_id) JOIN scales USING (contest_id) WHERE scale > 0
), prof AS (SELECT g.day_type, g.hr, p.mean, p.median, p.std, coalesce(p.cnt, 0) AS cnt FROM (SELECT unnest(['weekday', 'weekend']) AS day_type, h AS hr FROM range(0, 24) t(h)) g
  LEFT JOIN (SELECT day_type, hr, avg(norm_speed) AS mean, median(norm_speed) AS median, stddev_pop(norm_speed) AS std, count(*) AS cnt FROM nrm WHERE norm_speed <= 1.2
  GROUP BY ALL) p USING (day_type, hr)
), means AS (SELECT *, (5 * wd + 2 * we) / 7 AS g FROM (SELECT coalesce(avg(CASE WHEN day_type = 'weekday' AND mean > 0 THEN mean END), 1) AS wd, coalesce(avg(CASE
  WHEN day_type = 'weekend' AND mean > 0 THEN mean * 1.1 END), 1) AS we FROM prof)
), fac AS (SELECT day_type, hr, CASE WHEN mean > 0 THEN mean * (CASE WHEN day_type = 'weekend' THEN 1.1 ELSE 1 END) / g ELSE 1 END AS factor FROM prof, means
), sk AS (SELECT nrm.*, norm_speed / (CASE WHEN hours < 12 AND factor < 1 THEN 1 ELSE factor END) AS skeleton_speed FROM nrm JOIN fac USING (day_type, hr))"""


@query("a1_scale_from_points", "SELECT contest_id, round(scale, 6) AS scale FROM scales", speed=True)
def a1(spark, d):
    return scales(spark, d).select("contest_id", F.round("scale", 6).alias("scale"))


@query("a1_scale_as_of", f"""WITH u AS (SELECT contest_id, uid, (value - lag(value) OVER k) / nullif((time_ms - lag(time_ms) OVER k) / 60000.0, 0) AS speed FROM points
  WHERE time_ms <= {T0} + 259200000 * contest_id + 86400000 WINDOW k AS (PARTITION BY contest_id, uid ORDER BY time_ms, seq))
SELECT contest_id, round(avg(speed), 6) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY speed DESC, uid) AS r FROM u
  WHERE speed > 0 AND speed < 1e6) WHERE r <= 3 GROUP BY 1""")
def a1_as_of(spark, d):
    o = A.contests(spark, d).select("contest_id", (F.col("start_at") + 24 * HOUR_MS).alias("origin_ms"))
    return G.scale_from_points(A.points(spark, d), o).select("contest_id", F.round("scale", 6).alias("scale"))


@query("a2_scale_from_tracker", f"""WITH u AS (SELECT contest_id, time_ms, (score - lag(score) OVER k) / nullif((time_ms - lag(time_ms) OVER k) / 60000.0, 0) AS speed
  FROM obs WHERE tier = 50 WINDOW k AS (PARTITION BY contest_id ORDER BY time_ms, seq)),
r AS (SELECT u.contest_id, o * 24 AS origin_h, speed, row_number() OVER (PARTITION BY u.contest_id, o ORDER BY speed DESC, time_ms) AS r FROM u, range(1, 3) t(o)
  WHERE speed > 0 AND speed < 1e6 AND time_ms <= {T0} + 259200000 * contest_id + 86400000 * o)
SELECT c.contest_id, t.o * 24 AS origin_h, round(avg(r.speed), 6) AS scale FROM contests c CROSS JOIN range(1, 3) t(o) LEFT
  JOIN r ON r.contest_id = c.contest_id AND r.origin_h = t.o * 24 AND r.r <= 3 GROUP BY 1, 2""")
def a2(spark, d):
    o = S.daily_origins(A.contests(spark, d))
    return G.scale_from_tracker(A.obs(spark, d), 50, o).select("contest_id", F.col("origin_h").cast("long").alias("origin_h"), F.round("scale", 6).alias("scale"))


@query("f14_profile_window", """SELECT contest_id, tier, count(*) AS n FROM nrm
  WHERE time_ms >= start_at + 86400000 AND time_ms <= end_at - 86400000 AND norm_speed BETWEEN 0 AND 1.2 GROUP BY ALL""", speed=True, extra=NORM)
def f14(spark, d):
    return C.profile_window(normalised(spark, d), before_end=24).groupBy(*K).agg(F.count("*").alias("n"))


@query("a3_hourly_speed_profile", "SELECT day_type, hr AS hour, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, cnt FROM prof", speed=True, extra=NORM)
def a3(spark, d):
    return profile(spark, d).select("day_type", F.col("hour").cast("long").alias("hour"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "cnt")


_MIDDLE = """SELECT g.day_type, g.hr AS hour, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, coalesce(cnt, 0) AS cnt
  FROM (SELECT unnest(['weekday', 'weekend']) AS day_type, h AS hr FROM range(0, 24) t(h)) g LEFT JOIN (
  SELECT day_type, hr, avg(norm_speed) AS mean, median(norm_speed) AS median, stddev_pop(norm_speed) AS std, count(*) AS cnt FROM nrm
  WHERE tier = 1000 AND scale >= 100 AND time_ms BETWEEN start_at + 86400000 AND end_at - 43200000 AND norm_speed BETWEEN 0 AND 1.2 GROUP BY ALL) p USING (day_type, hr)"""


@query("a3_contest_profile", _MIDDLE, speed=True, extra=NORM)
def a3_contest(spark, d):
    """The middle of these short contests ends twelve hours before their end."""
    p = G.contest_profile(normalised(spark, d), before_end=12)
    return p.select("day_type", F.col("hour").cast("long").alias("hour"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "cnt")


@query("a4_profile_means", "SELECT round(wd, 6) AS weekday_mean, round(we, 6) AS weekend_mean, round(g, 6) AS global_mean FROM means", speed=True, extra=NORM)
def a4(spark, d):
    return G.profile_means(profile(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("weekday_mean", "weekend_mean", "global_mean")])


@query("j7_attach_season_factor", "SELECT contest_id, tier, count(*) AS n, round(sum(skeleton_speed), 6) AS total FROM sk GROUP BY ALL", speed=True, extra=NORM)
def j7(spark, d):
    return skeletons(spark, d).groupBy(*K).agg(F.count("*").alias("n"), F.round(F.sum("skeleton_speed"), 6).alias("total"))


_INTENSITY = """SELECT contest_id, tier, CASE WHEN max(s) > 0.001 THEN coalesce(avg(CASE WHEN abs(skeleton_speed - m) < 2 * s THEN skeleton_speed END), max(m)) ELSE max(m) END AS i
  FROM (SELECT *, avg(skeleton_speed) OVER w AS m, stddev_samp(skeleton_speed) OVER w AS s FROM sk WHERE hours BETWEEN 6 AND 48 WINDOW w AS (PARTITION BY contest_id, tier)) GROUP BY ALL"""


@query("a5_window_intensity", f"SELECT contest_id, tier, round(i, 6) AS intensity FROM ({_INTENSITY})", speed=True, extra=NORM)
def a5(spark, d):
    rows = skeletons(spark, d).withColumns({"t0": F.lit(6.0), "t1": F.lit(48.0)})
    return G.window_intensity(rows, K).select(*K, F.round("intensity", 6).alias("intensity"))


@query("a6_window_mean", "SELECT contest_id, tier, round(avg(norm_speed), 6) AS window_mean FROM nrm WHERE hours BETWEEN 6 AND 48 GROUP BY ALL", speed=True, extra=NORM)
def a6(spark, d):
    rows = normalised(spark, d).withColumns({"t0": F.lit(6.0), "t1": F.lit(48.0)})
    return G.window_mean(rows, "norm_speed", K).select(*K, F.round("window_mean", 6).alias("window_mean"))


def history(spark, d, k=3):
    return J.select_history(A.contests(spark, d), scales(spark, d), k, (2,))


def blended(c, of_scales, rows):
    """Window statistics of each contest's three histories, over contests, scales and skeleton speeds that are made once."""
    h = c.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("h"))
    pairs = J.select_history(c, of_scales, 3, (2,)).join(h.withColumnRenamed("h", "history_hours"), "contest_id").join(h.select(F.col("contest_id").alias("target_id"), F.col("h").alias("target_hours")), "target_id")
    pairs = pairs.join(rows.select(*K).distinct(), "contest_id").withColumns({"t0": F.lit(6.0), "t1": F.lit(48.0)}).drop("rank")
    return G.blended_window_stats(cut(pairs), rows.select(*K, "hours", "norm_speed", "skeleton_speed"))


def shared(spark, d):
    """Contests, scales and skeleton speeds, each written once."""
    c, of_scales = cut(A.contests(spark, d)), cut(scales(spark, d))
    n = cut(S.attach_scale(S.interval_speed(C.elapsed_and_phase(A.obs(spark, d), c)), of_scales))
    return c, of_scales, cut(G.attach_season_factor(n, G.season_factors(G.hourly_speed_profile(n.where("norm_speed <= 1.2"), exact=False))))


HIST = """, h0 AS (SELECT c.contest_id, lower(contest_type) AS ty, start_at, end_at, (end_at - start_at) / 3600000.0 AS dur, scale > 0 AND contest_id <> 2 AS good
  FROM contests c LEFT JOIN scales USING (contest_id)
), hist AS (SELECT target_id, contest_id, rank, td, hd FROM (SELECT t.contest_id AS target_id, h.contest_id, t.dur AS td, h.dur AS hd,
  row_number() OVER (PARTITION BY t.contest_id ORDER BY h.contest_id DESC) AS rank FROM h0 t JOIN h0 h ON t.ty = h.ty AND h.contest_id < t.contest_id AND h.good)
  WHERE rank <= 3
), pr AS (SELECT h.*, o.tier, least(abs(ln(td / hd)) / 0.18, 1) * 0.75 AS wt FROM hist h JOIN (SELECT DISTINCT contest_id, tier FROM obs) o USING (contest_id)
), wr AS (SELECT pr.target_id, pr.contest_id, pr.tier, pr.wt, k.kind, sk.norm_speed, sk.skeleton_speed, avg(skeleton_speed) OVER w AS m,
  stddev_samp(skeleton_speed) OVER w AS s FROM pr JOIN sk ON sk.contest_id = pr.contest_id AND sk.tier = pr.tier CROSS JOIN (VALUES ('a'), ('p')) k(kind)
  WHERE sk.hours BETWEEN CASE WHEN kind = 'a' THEN 6 ELSE 6 / td * hd END AND CASE WHEN kind = 'a' THEN 48 ELSE 48 / td * hd END WINDOW w AS (PARTITION BY pr.target_id, pr.contest_id, pr.tier, k.kind)
), ws AS (SELECT target_id, contest_id, tier, kind, max(wt) AS wt, avg(norm_speed) AS n, CASE WHEN max(s) > 0.001 THEN coalesce(avg(CASE
  WHEN abs(skeleton_speed - m) < 2 * s THEN skeleton_speed END), max(m)) ELSE max(m) END AS i FROM wr GROUP BY ALL
), bl AS (SELECT p.target_id, p.contest_id, p.tier, CASE WHEN p.wt <= 0 THEN a.i ELSE coalesce((1 - p.wt) * a.i + p.wt * q.i, a.i, q.i) END AS intensity, CASE
  WHEN p.wt <= 0 THEN a.n ELSE coalesce((1 - p.wt) * a.n + p.wt * q.n, a.n, q.n) END AS norm_mean
  FROM pr p LEFT JOIN ws a ON a.target_id = p.target_id AND a.contest_id = p.contest_id AND a.tier = p.tier AND a.kind = 'a' LEFT
  JOIN ws q ON q.target_id = p.target_id AND q.contest_id = p.contest_id AND q.tier = p.tier AND q.kind = 'p')"""


@query("a7_blended_window_stats", "SELECT target_id, contest_id, tier, round(intensity, 6) AS intensity, round(norm_mean, 6) AS norm_mean FROM bl", speed=True, extra=NORM + HIST)
def a7(spark, d):
    return blended(*shared(spark, d)).select("target_id", *K, F.round("intensity", 6).alias("intensity"), F.round("norm_mean", 6).alias("norm_mean"))


def ratios(spark, d):
    c, of_scales, sk = shared(spark, d)
    own = sk.groupBy(*K).agg(F.max("hours").alias("observed_h"))
    windows = own.select(F.lit("own").alias("kind"), *K, F.lit(6.0).alias("lo"), F.lit(48.0).alias("hi"))
    t = own.join(window_statistics(sk, windows, ["kind"]).drop("kind"), K, "left")
    return G.strength_ratio(t.withColumnRenamed("contest_id", "target_id"), blended(c, of_scales, sk))


@query("a8_strength_ratio", f"""WITH tg AS (SELECT o.contest_id AS target_id, o.tier, o.oh, x.i, n.nm, h.hi, h.hn FROM (SELECT contest_id, tier, max(hours) AS oh FROM sk
  GROUP BY ALL) o LEFT JOIN ({_INTENSITY}) x USING (contest_id, tier) LEFT JOIN (SELECT contest_id, tier, avg(norm_speed) AS nm FROM nrm WHERE hours BETWEEN 6 AND 48
  GROUP BY ALL) n USING (contest_id, tier)
  LEFT JOIN (SELECT target_id, tier, avg(intensity) AS hi, avg(norm_mean) AS hn FROM bl GROUP BY ALL) h ON h.target_id = o.contest_id AND h.tier = o.tier),
v AS (SELECT *, greatest(0, least(1, 0.2 + 0.6 * cos((least(1, oh / 72.0) - 1) * pi()))) AS w FROM tg)
SELECT target_id, tier, round(CASE WHEN i IS NULL OR hi IS NULL THEN 1 ELSE greatest(0.25, least(4.0, CASE WHEN hi > 0 THEN i / hi ELSE 1 END * (1 - w) + CASE
  WHEN hn > 0 THEN coalesce(nm, 0) / hn ELSE 1 END * w)) END, 6) AS ratio FROM v""", speed=True, extra=NORM + HIST)
def a8(spark, d):
    return ratios(spark, d).select("target_id", "tier", F.round("ratio", 6).alias("ratio"))


@query("a9_special_reward_tiers", """WITH r AS (SELECT contest_id, CASE WHEN reward_id IS NULL THEN reward_type ELSE reward_type || ':' || reward_id END AS k,
  max(to_rank) AS r FROM rewards WHERE reward_type NOT IN ('item', 'practice_ticket', 'star', 'degree', 'bili_degree_effect') GROUP BY ALL)
SELECT contest_id, string_agg(k || '=' || r, ',' ORDER BY k) AS appearances, array_to_string(list_sort(list_distinct(list(r))), ',') AS targets FROM r GROUP BY 1""")
def a9(spark, d):
    g = G.special_reward_tiers(A.rewards(spark, d))
    items = F.array_sort(F.map_entries("last_appearance"))
    return g.select("contest_id", F.array_join(F.transform(items, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("appearances"), F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


CLASSES = """, cls AS (SELECT contest_id, c AS reward_class, CASE WHEN count(DISTINCT to_rank) = 1 THEN max(to_rank) END AS rank, count(DISTINCT to_rank) > 1 AS ambiguous FROM (
  SELECT contest_id, to_rank, CASE WHEN reward_type = 'deco_pins' THEN 'deco_pins' WHEN reward_type = 'voice_stamp' AND reward_id >= 10000 THEN 'premium'
  WHEN reward_type = 'voice_stamp' AND reward_id IS NOT NULL THEN 'standard' END AS c FROM rewards) WHERE c IS NOT NULL GROUP BY ALL)"""


@query("a10_reward_class_ranks", "SELECT contest_id, reward_class, rank, ambiguous FROM cls", extra=CLASSES)
def a10(spark, d):
    return G.reward_class_ranks(A.rewards(spark, d))


_REPORT = """WITH og AS (SELECT contest_id, start_at + h * 3600000 AS om FROM contests, (VALUES (24), (48)) t(h)),
r AS (SELECT d.contest_id, om, tier, time_ms, score, available_at, seq, score < 0 AS bv FROM dirty d JOIN og ON og.contest_id = d.contest_id),
r2 AS (SELECT *, NOT bv AND time_ms > om AS late, NOT bv AND time_ms <= om AND available_at > om AS fut FROM r),
r3 AS (SELECT *, NOT bv AND NOT late AND NOT fut AS ok FROM r2),
r4 AS (SELECT *, count(*) OVER (PARTITION BY contest_id, om, tier, ok, time_ms) AS same,
  ok AND row_number() OVER (PARTITION BY contest_id, om, tier, ok, time_ms ORDER BY available_at DESC, seq DESC) = 1 AS one FROM r3),
r5 AS (SELECT *, one AND coalesce(score < lag(score) OVER (PARTITION BY contest_id, om, tier, one ORDER BY time_ms), false) AS falls FROM r4),
g AS (SELECT contest_id, om, tier, count(*) AS raw_rows, count(*) FILTER (WHERE bv) AS invalid_value, count(*) FILTER (WHERE late) AS post_origin,
  count(*) FILTER (WHERE fut) AS future_available, count(*) FILTER (WHERE ok AND same > 1) AS duplicate_rows, count(*) FILTER (WHERE falls) AS falls,
  count(*) FILTER (WHERE one) AS usable FROM r5 GROUP BY ALL),
q AS (SELECT og.contest_id, og.om AS origin_ms, t.tier, coalesce(raw_rows, 0) AS raw_rows, coalesce(invalid_value, 0) AS invalid_value, coalesce(post_origin, 0) AS post_origin,
  coalesce(future_available, 0) AS future_available, coalesce(duplicate_rows, 0) AS duplicate_rows, coalesce(falls, 0) AS falls, coalesce(usable, 0) AS usable,
  CASE WHEN raw_rows IS NULL THEN 'missing' WHEN usable = 0 THEN 'no_usable_as_of_records' ELSE 'ok' END AS status,
  CASE WHEN raw_rows IS NULL THEN 'unknown_degraded_missing_tier' ELSE 'explicit_row_level' END AS availability
  FROM og CROSS JOIN (VALUES (10), (50), (500), (1000)) t(tier) LEFT JOIN g ON g.contest_id = og.contest_id AND g.om = og.om AND g.tier = t.tier)"""


def report(spark, d):
    """Two origins of each contest."""
    hours = F.explode(F.array(F.lit(24), F.lit(48)))
    o = A.contests(spark, d).select("contest_id", "start_at", hours.alias("h")).select("contest_id", (F.col("start_at") + F.col("h") * HOUR_MS).alias("origin_ms"))
    tiers = spark.range(1).select(F.explode(F.array(F.lit(10), F.lit(50), F.lit(500), F.lit(1000))).alias("tier"))
    return G.tier_quality_report(A.obs_dirty(spark, d), o, tiers)


@query("a11_tier_quality_report", _REPORT + " SELECT * FROM q")
def a11(spark, d):
    return report(spark, d).drop("invalid_time", "unknown_available")


_ROLLUP = """ SELECT contest_id, origin_ms, CAST(sum(raw_rows) AS BIGINT) AS raw_rows, CAST(sum(usable) AS BIGINT) AS usable, CAST(sum(post_origin) AS BIGINT) AS post_origin,
  CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows, CAST(sum(falls) AS BIGINT) AS falls, count(*) FILTER (WHERE status = 'ok') AS observed, count(*) AS requested,
  coalesce(string_agg(CASE WHEN status <> 'ok' THEN tier || '' END, ',' ORDER BY tier), '') AS missing, count(*) FILTER (WHERE status = 'ok') / count(*) AS completeness,
  CASE WHEN count(*) FILTER (WHERE availability NOT LIKE 'explicit%') > 0 THEN 'degraded_timestamp_only' ELSE 'explicit_available_at' END AS availability FROM q GROUP BY 1, 2"""


@query("a11_quality_rollup", _REPORT + _ROLLUP)
def a11_rollup(spark, d):
    return G.quality_rollup(report(spark, d)).withColumn("missing", F.array_join(F.transform("missing", lambda t: t.cast("string")), ","))


@query("a12_contest_cache_index", """SELECT contest_id, contest_type, count(*) AS record_count, arg_max(score, (time_ms, seq)) AS final_score, round(max(scale),
  6) AS scale FROM obs JOIN contests USING (contest_id) LEFT JOIN scales USING (contest_id) WHERE tier = 1000 GROUP BY ALL""", speed=True)
def a12(spark, d):
    return G.contest_cache_index(A.obs(spark, d), scales(spark, d), A.contests(spark, d), 1000).withColumn("scale", F.round("scale", 6))


def _truth(where):
    return f"""SELECT contest_id, tier, arg_max(score, seq) AS actual, count(*) > 1 AS ambiguous FROM (SELECT *, min(time_ms) OVER (PARTITION BY contest_id, tier) AS f
  FROM dirty JOIN contests USING (contest_id) WHERE time_ms > end_at{where}) WHERE time_ms = f GROUP BY ALL"""


@query("a13_final_truth_first", _truth(""))
def a13(spark, d):
    return G.final_truth(A.obs_dirty(spark, d), A.contests(spark, d))


@query("a13_final_truth_bucket20", _truth(" AND time_ms <= end_at + 1200000").replace("dirty", "obs"))
def a13b(spark, d):
    return G.final_truth(A.obs(spark, d), A.contests(spark, d), "bucket20")


@query("a13_final_truth_last", "SELECT contest_id, tier, arg_max(score, (time_ms, seq)) AS actual, false AS ambiguous FROM obs GROUP BY ALL")
def a13l(spark, d):
    return G.final_truth(A.obs(spark, d), A.contests(spark, d), "last")


SONGS = """, sg AS (SELECT o_custkey AS song_id, [10,20,30,40,50,100,200,300,400,500,1000,1500,2000][o_orderkey % 13 + 1] AS tier, max(o_totalprice) AS score FROM orders GROUP BY ALL),
nm AS (SELECT song_id, tier, score / first_value(score) OVER w AS norm, tier / first_value(tier) OVER w AS rel FROM sg WHERE score > 0 WINDOW w AS (PARTITION BY song_id ORDER BY tier))"""


@query("a27_rank_shape_tiers", "SELECT tier, count(*) AS n, " + ", ".join(f"round(quantile_cont(norm, {q}), 6) AS q{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM nm GROUP BY tier", extra=SONGS)
def a27(spark, d):
    t, _ = G.rank_shape_profile(A.song_scores(spark, d))
    return t.select("tier", "n", *[F.round(c, 6).alias(c) for c in t.columns if c[0] == "q"])


@query("a27_rank_shape_fits", """SELECT song_id, count(*) AS n, round(regr_intercept(ln(norm), ln(rel)), 6) + 0.0 AS intercept, round(regr_slope(ln(norm), ln(rel)),
  6) AS slope, round(-regr_slope(ln(norm), ln(rel)), 6) AS alpha FROM nm GROUP BY song_id HAVING count(*) >= 2""", extra=SONGS)
def a27_fits(spark, d):
    _, f = G.rank_shape_profile(A.song_scores(spark, d))
    return f.select("song_id", "n", (F.round("intercept", 6) + 0.0).alias("intercept"), *[F.round(c, 6).alias(c) for c in ("slope", "alpha")])  # a sum of opposites may be -0.0


FEATURES = """, ft AS (SELECT o.contest_id, o.tier, count(*) AS points, count(*) / greatest(max((end_at - start_at) / 3600000.0), 1) AS coverage, (arg_max(score,
  (time_ms, seq)) - max(t.actual)) / greatest(max(t.actual), 1) AS signed_rel
  FROM obs o JOIN contests USING (contest_id) LEFT JOIN (SELECT contest_id, tier, arg_max(score, (time_ms, seq)) AS actual FROM obs
  GROUP BY ALL) t ON t.contest_id = o.contest_id AND t.tier = o.tier WHERE time_ms BETWEEN start_at AND end_at GROUP BY o.contest_id, o.tier)"""


def features(spark, d):
    o, c = A.obs(spark, d), A.contests(spark, d)
    return G.activity_features(o, c, G.final_truth(o, c, "last"))


@query("a24_activity_features", "SELECT contest_id, tier, points, round(coverage, 6) AS coverage, round(signed_rel, 6) AS signed_rel FROM ft", extra=FEATURES)
def a24(spark, d):
    return features(spark, d).select(*K, "points", F.round("coverage", 6).alias("coverage"), F.round("signed_rel", 6).alias("signed_rel"))


@query("a24_panic_hours", f"SELECT contest_id, tier, points, round(panic_h, 6) AS panic_h FROM (SELECT ft.*, 20.0 + contest_id AS panic_h FROM ft)", extra=FEATURES)
def a24_panic(spark, d):
    """The length of the final phase, which begins at a stated hour."""
    o, c = A.obs(spark, d), A.contests(spark, d)
    start = (F.col("end_at") - F.col("start_at")) / float(HOUR_MS) - 20.0 - F.col("contest_id")
    panic = o.select(*K).distinct().join(c, "contest_id").select(*K, start.alias("panic_start_h"))
    return G.activity_features(o, c, G.final_truth(o, c, "last"), panic).select(*K, "points", F.round("panic_h", 6).alias("panic_h"))


@query("a24_standardize", """SELECT contest_id, tier, points, round((coverage - avg(coverage) OVER ()) / greatest(stddev_pop(coverage) OVER (), 1e-9), 6) AS coverage,
  round((signed_rel - avg(signed_rel) OVER ()) / greatest(stddev_pop(signed_rel) OVER (), 1e-9), 6) AS signed_rel FROM ft""", extra=FEATURES)
def a24_z(spark, d):
    return G.standardize(features(spark, d), ["coverage", "signed_rel"]).select(*K, "points", F.round("coverage", 6).alias("coverage"), F.round("signed_rel", 6).alias("signed_rel"))


@query("j1_history_offline", "SELECT target_id, contest_id, rank FROM hist", speed=True, extra=NORM + HIST)
def j1(spark, d):
    return history(spark, d).select("target_id", "contest_id", F.col("rank").cast("long").alias("rank"))


#: Contests that are no histories in the online and causal modes.
IGNORED = (5, 7)


def _modes(k: int, when: str = "") -> str:
    return f"""c AS (SELECT c.contest_id, contest_type AS ty, start_at, end_at, coalesce(scale > 0, false) AND contest_id % 5 <> 1 AS good FROM contests c LEFT JOIN scales USING (contest_id)),
a AS (SELECT t.contest_id AS target_id, h.contest_id, h.good, row_number() OVER (PARTITION BY t.contest_id ORDER BY h.contest_id DESC) AS r0 FROM c t
  JOIN c h ON lower(t.ty) = lower(h.ty) AND h.contest_id < t.contest_id AND h.contest_id NOT IN {IGNORED}{when}),
b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY contest_id DESC) AS rank FROM a WHERE r0 <= {k + 3} AND good)"""


def unscaled(spark, d):
    """Scales of which every fifth cannot be used."""
    return scales(spark, d).withColumn("scale", F.when(F.col("contest_id") % 5 == 1, 0.0).otherwise(F.col("scale")))


@query("j1_history_online", f"WITH {_modes(2)} SELECT target_id, contest_id, rank FROM b WHERE rank <= 2", speed=True)
def j1_online(spark, d):
    return J.select_history(A.contests(spark, d), unscaled(spark, d), 2, IGNORED, "online").select("target_id", "contest_id", F.col("rank").cast("long").alias("rank"))


@query("j1_history_causal", f"WITH {_modes(2, ' AND h.end_at < t.start_at')} SELECT target_id, contest_id, rank FROM b WHERE rank <= 2", speed=True)
def j1_causal(spark, d):
    return J.select_history(A.contests(spark, d), unscaled(spark, d), 2, IGNORED, "causal").select("target_id", "contest_id", F.col("rank").cast("long").alias("rank"))


@query("j2_eligible_contests", "SELECT contest_id FROM contests WHERE contest_id IN (SELECT target_id FROM hist GROUP BY target_id HAVING count(*) >= 3)", speed=True, extra=NORM + HIST)
def j2(spark, d):
    return J.eligible_contests(A.contests(spark, d), history(spark, d), 3).select("contest_id")


@query("j9_missing_tiers", """WITH e AS (SELECT contest_id, t.tier FROM contests, (VALUES (10), (50), (1000), (2000)) t(tier)), o AS (SELECT DISTINCT contest_id, tier
  FROM dirty) SELECT e.contest_id, e.tier, 'missing' AS kind FROM e ANTI JOIN o ON e.contest_id = o.contest_id AND e.tier = o.tier UNION ALL SELECT o.contest_id, o.tier,
  'unexpected' FROM o ANTI JOIN e ON e.contest_id = o.contest_id AND e.tier = o.tier""")
def j9(spark, d):
    e = A.contests(spark, d).select("contest_id", F.explode(F.array(F.lit(10), F.lit(50), F.lit(1000), F.lit(2000))).alias("tier"))
    return J.missing_tiers(e, A.obs_dirty(spark, d))


@query("u2_common_history", f"""WITH {_modes(4, ' AND h.end_at < t.start_at')} SELECT target_id, contest_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY
  target_id ORDER BY contest_id DESC) AS rank FROM (SELECT target_id, contest_id FROM hist INTERSECT SELECT target_id, contest_id FROM b WHERE rank <= 4)) WHERE rank <= 1""", speed=True, extra=NORM + HIST)
def u2(spark, d):
    """The newest history that both the offline and the causal selection have."""
    b = J.select_history(A.contests(spark, d), unscaled(spark, d), 4, IGNORED, "causal")
    return J.common_history(history(spark, d), b, 1).select("target_id", "contest_id", F.col("rank").cast("long").alias("rank"))


#: All rewards, at a rank of their class; but in every fourth contest at their own, where classes are ambiguous.
RANKED = CLASSES.replace("FROM rewards)", """FROM (SELECT contest_id, reward_type, reward_id, CASE WHEN contest_id % 4 = 3 THEN to_rank
  ELSE [50, 100, 300, 500, 1000, 2000][(contest_id * 5 + length(reward_type) + CASE WHEN reward_id >= 10000 THEN 1 ELSE 0 END) % 6 + 1] END AS to_rank FROM rewards))""")


@query("j11_map_reward_class", """WITH c AS (SELECT * FROM cls WHERE rank IS NOT NULL), own AS (SELECT contest_id AS target_id, rank AS tier,
  max(reward_class) AS reward_class FROM c GROUP BY contest_id, rank HAVING count(*) = 1)
SELECT target_id, own.tier, own.reward_class, h.contest_id, c.rank AS mapped_tier FROM own JOIN hist h USING (target_id)
  JOIN c ON c.contest_id = h.contest_id AND c.reward_class = own.reward_class""", speed=True, extra=NORM + HIST + RANKED)
def j11(spark, d):
    place = (F.col("contest_id") * 5 + F.length("reward_type") + F.coalesce((F.col("reward_id") >= 10_000).cast("int"), F.lit(0))) % 6
    ranked = F.when(F.col("contest_id") % 4 == 3, F.col("to_rank")).otherwise(F.get(F.array(*[F.lit(t) for t in TRAINING_TIERS]), place.cast("int")))
    cls = G.reward_class_ranks(A.rewards(spark, d).withColumn("to_rank", ranked))
    targets = cls.where("rank is not null").select(F.col("contest_id").alias("target_id"), F.col("rank").alias("tier")).distinct()
    return J.map_reward_class(targets, cls, history(spark, d))


@query("j12_route_source", """WITH v AS (SELECT contest_id, tier, source FROM obs WHERE contest_id % 2 = 0 OR source = 'a' GROUP BY ALL HAVING min(score) >= 0),
  b AS (SELECT contest_id, tier, min(CASE source WHEN 'b' THEN 1 ELSE 2 END) AS p FROM v GROUP BY ALL)
SELECT contest_id, tier, source, 'b' AS requested_source, source <> 'b' AS fallback_used, count(*) AS n FROM obs JOIN b USING (contest_id, tier)
  WHERE (contest_id % 2 = 0 OR source = 'a') AND source = CASE p WHEN 1 THEN 'b' ELSE 'a' END GROUP BY ALL""")
def j12(spark, d):
    o = A.obs(spark, d).where("contest_id % 2 = 0 or source = 'a'")
    return J.route_source(o, ("b", "a")).groupBy(*K, "source", "requested_source", "fallback_used").agg(F.count("*").alias("n"))
