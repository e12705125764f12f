"""Queries of errors, means, coverage, selection and plans; the flagship asks how wrong naive forecasts are."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.operators import aggregates as G
from podium.operators import clean as C
from podium.operators import evaluate as E
from podium.operators import joins as J
from podium.operators import series as S
from podium.plans import adapters as A
from podium.plans.registry import query
from podium.plans.series_queries import scales
from podium.schema import K

METHODS = ("persistence", "last_slope", "average_speed")


def scored(spark, d):
    """Scoring rows of the naive forecasts at daily origins: (contest_id, tier, origin_h, method, status, reason, prediction, actual, contest_type, phase)."""
    o, c = A.obs(spark, d), A.contests(spark, d)
    grid = o.select(*K).distinct().join(S.daily_origins(c).select("contest_id", "origin_h"), "contest_id")
    at = S.daily_origins(c)
    f = S.baseline_forecasts(S.prefix_join(S.last_rows(o, at), at), c)
    j = grid.join(f, [*K, "origin_h"], "left").unpivot([*K, "origin_h"], list(METHODS), "method", "prediction")
    # one method fails on purpose where its forecast is more than four times the last score
    j = j.withColumn("prediction", F.when((F.col("method") == "last_slope") & (F.col("contest_id") % 3 == 1) & (F.col("tier") == 50), None).otherwise(F.round("prediction", 4)))
    ok = F.col("prediction").isNotNull()
    j = j.withColumns({"status": F.when(ok, "success").otherwise("failed"), "reason": F.when(~ok, "no_forecast")})
    truth = G.final_truth(o, c, "bucket20").select(*K, "actual")  # joined last: no forecast sees it
    rows = j.join(truth, K, "left").join(c.select("contest_id", "contest_type"), "contest_id")
    return rows.withColumn("phase", F.when(F.col("origin_h") < 24, "early").when(F.col("origin_h") < 47, "middle").otherwise("late"))


def errors(spark, d):
    return E.error_metrics(scored(spark, d))


SCORED = """, pf AS (
  SELECT contest_id, tier, origin_h, a AS persistence, a + greatest(0, coalesce((a - b) / nullif((ta - tb) / 3600000.0, 0), 0)) * (end_at - ta) / 3600000.0 AS last_slope,
  a * ((end_at - start_at) / 3600000.0) / nullif((ta - start_at) / 3600000.0, 0) AS average_speed FROM (
  SELECT contest_id, tier, origin_h, start_at, end_at, max(CASE WHEN r = 1 THEN score END) AS a, max(CASE WHEN r = 2 THEN score END) AS b, max(CASE
  WHEN r = 1 THEN time_ms END) AS ta, max(CASE WHEN r = 2 THEN time_ms END) AS tb
  FROM (SELECT o.contest_id, o.tier, o.time_ms, o.score, k * 24 AS origin_h, start_at, end_at, row_number() OVER (PARTITION BY o.contest_id, o.tier,
  k ORDER BY o.time_ms DESC, seq DESC) AS r FROM obs o JOIN contests USING (contest_id), range(1, 3) t(k) WHERE o.time_ms <= start_at + k * 86400000) WHERE r <= 2
  GROUP BY ALL) WHERE b IS NOT NULL
), tr AS (
  SELECT contest_id, tier, arg_max(score, seq) AS actual FROM (SELECT *, min(time_ms) OVER (PARTITION BY contest_id, tier) AS f FROM obs JOIN contests USING (contest_id)
  WHERE time_ms > end_at AND time_ms <= end_at + 1200000) WHERE time_ms = f GROUP BY ALL
), sc AS (
  SELECT g.contest_id, g.tier, g.origin_h, m.method, CASE WHEN m.method = 'last_slope' AND g.contest_id % 3 = 1 AND g.tier = 50 THEN NULL ELSE round(CASE m.method
  WHEN 'persistence' THEN persistence WHEN 'last_slope' THEN last_slope ELSE average_speed END, 4) END AS prediction, tr.actual, c.contest_type,
    CASE WHEN g.origin_h < 24 THEN 'early' WHEN g.origin_h < 47 THEN 'middle' ELSE 'late' END AS phase
  FROM (SELECT DISTINCT contest_id, tier, k * 24 AS origin_h FROM obs, range(1, 3) t(k)) g CROSS JOIN (VALUES ('persistence'), ('last_slope'),
  ('average_speed')) m(method) JOIN contests c USING (contest_id)
  LEFT JOIN pf ON pf.contest_id = g.contest_id AND pf.tier = g.tier AND pf.origin_h = g.origin_h LEFT JOIN tr ON tr.contest_id = g.contest_id AND tr.tier = g.tier
), er AS (
  SELECT *, prediction - actual AS error, abs(prediction - actual) AS abs_error, CASE WHEN actual <> 0 THEN 100 * (prediction - actual) / actual END AS pct, abs(CASE
  WHEN actual <> 0 THEN 100 * (prediction - actual) / actual END) AS ape,
    CASE WHEN abs(prediction) + abs(actual) = 0 THEN 0 ELSE 200 * abs(prediction - actual) / (abs(prediction) + abs(actual)) END AS smape, CASE
  WHEN prediction IS NOT NULL THEN 'success' ELSE 'failed' END AS status FROM sc
), ce AS (
  SELECT contest_id, tier, method, avg(ape) AS mape, avg(abs_error) AS mae, avg(smape) AS smape, avg(pct) AS bias, sqrt(avg(error * error)) AS rmse, count(*) AS n
  FROM er WHERE status = 'success' AND actual IS NOT NULL GROUP BY ALL
), cm AS (SELECT contest_id, method, avg(mape) AS mape, avg(mae) AS mae, avg(smape) AS smape, avg(bias) AS bias, avg(rmse) AS rmse, CAST(sum(n) AS BIGINT) AS n FROM ce GROUP BY ALL
), om AS (SELECT method, avg(mape) AS mape, avg(mae) AS mae, avg(smape) AS smape, avg(bias) AS bias, avg(rmse) AS rmse, CAST(sum(n) AS BIGINT) AS n FROM cm GROUP BY ALL)"""
_M = ("mape", "mae", "smape", "bias", "rmse")
_ROUNDED = ", ".join(f"round({c}, 3) AS {c}" for c in _M)


def _rounded(df):
    return df.select(*[F.round(c, 3).alias(c) if c in _M else F.col(c) for c in df.columns])


@query("flagship_baseline_errors", f"SELECT method, {_ROUNDED}, n FROM om", extra=SCORED)
def flagship(spark, d):
    m = E.hierarchical_metrics(errors(spark, d)).where("level = 'overall'")
    return _rounded(m.select("method", *_M, "n"))


@query("a14_error_metrics", "SELECT contest_id, tier, origin_h, method, round(error, 4) AS error, round(ape, 4) AS ape, round(smape, 4) AS smape FROM er", extra=SCORED)
def a14(spark, d):
    return errors(spark, d).select(*K, F.col("origin_h").cast("long").alias("origin_h"), "method", *[F.round(c, 4).alias(c) for c in ("error", "ape", "smape")])


@query("a15_hierarchical_metrics", f"""SELECT method, 'cell' AS level, contest_id, tier, {_ROUNDED}, n FROM ce UNION ALL SELECT method, 'contest', contest_id, NULL,
  {_ROUNDED}, n FROM cm UNION ALL SELECT method, 'tier', NULL, tier, {', '.join(f'round(avg({c}), 3)' for c in _M)}, CAST(sum(n) AS BIGINT) FROM ce GROUP BY method, tier
  UNION ALL SELECT method, 'overall', NULL, NULL, {_ROUNDED}, n FROM om""", extra=SCORED)
def a15(spark, d):
    return _rounded(E.hierarchical_metrics(errors(spark, d)))


@query("a16_sliced_metrics", f"""WITH s AS (SELECT 'all' AS dim, 'all' AS value, * FROM er UNION ALL SELECT 'contest_type', contest_type, * FROM er UNION ALL SELECT 'phase', phase, * FROM er),
c1 AS (SELECT dim, value, contest_id, tier, method, avg(ape) AS mape, avg(abs_error) AS mae, avg(smape) AS smape, avg(pct) AS bias, sqrt(avg(error * error)) AS rmse,
  count(*) AS n FROM s WHERE status = 'success' AND actual IS NOT NULL GROUP BY ALL),
c2 AS (SELECT dim, value, contest_id, method, {", ".join(f"avg({c}) AS {c}" for c in _M)}, sum(n) AS n FROM c1 GROUP BY ALL)
SELECT dim, value, method, {", ".join(f"round(avg({c}), 3) AS {c}" for c in _M)}, CAST(sum(n) AS BIGINT) AS n FROM c2 GROUP BY dim, value, method""", extra=SCORED)
def a16(spark, d):
    return _rounded(E.sliced_metrics(errors(spark, d), ["contest_type", "phase"]))


@query("a17_coverage_report", """SELECT method, contest_id, count(*) AS scheduled, count(*) FILTER (WHERE actual IS NOT NULL) AS evaluable,
  count(*) FILTER (WHERE actual IS NOT NULL) AS attempted, count(*) FILTER (WHERE actual IS NOT NULL AND status = 'success') AS success,
  count(*) FILTER (WHERE actual IS NOT NULL AND status <> 'success') AS failure,
  CASE WHEN count(*) FILTER (WHERE status <> 'success') > 0 THEN '{"no_forecast":' || count(*) FILTER (WHERE status <> 'success') || '}' END AS reasons,
  count(*) FILTER (WHERE actual IS NOT NULL AND status = 'success') / nullif(count(*) FILTER (WHERE actual IS NOT NULL), 0) AS success_share,
  CASE WHEN count(*) FILTER (WHERE actual IS NOT NULL) = 0 THEN 'n.a.'
  WHEN count(*) FILTER (WHERE actual IS NOT NULL AND status = 'success') = count(*) FILTER (WHERE actual IS NOT NULL) THEN 'complete'
  WHEN count(*) FILTER (WHERE actual IS NOT NULL AND status = 'success') > 0 THEN 'partial' ELSE 'unavailable' END AS support FROM er GROUP BY method, contest_id""", extra=SCORED)
def a17(spark, d):
    return E.coverage_report(errors(spark, d), ["contest_id"])


_PAIR = """WITH p AS (SELECT contest_id, tier, origin_h, max(CASE WHEN method = 'average_speed' THEN ape END) AS x, max(CASE
  WHEN method = 'last_slope' THEN ape END) AS y FROM er WHERE status = 'success' GROUP BY ALL HAVING max(CASE
  WHEN method = 'average_speed' THEN ape END) IS NOT NULL AND max(CASE WHEN method = 'last_slope' THEN ape END) IS NOT NULL),
q AS (SELECT contest_id, avg(x) AS a, avg(y) AS b FROM (SELECT contest_id, tier, avg(x) AS x, avg(y) AS y FROM p GROUP BY ALL) GROUP BY 1)"""


@query("a18_paired_comparison", _PAIR + " SELECT round(avg(a), 4) AS mape_a, round(avg(b), 4) AS mape_b, round(avg(b - a), 4) AS delta, count(*) FILTER (WHERE a < b) AS wins_a, count(*) AS contests FROM q", extra=SCORED)
def a18(spark, d):
    p = E.paired_comparison(errors(spark, d), "average_speed", "last_slope")
    return p.select(*[F.round(c, 4).alias(c) for c in ("mape_a", "mape_b", "delta")], "wins_a", "contests")


def md5_uniform(*parts: str) -> str:
    """SQL for evaluate.uniform."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


_DRAWS = f""", nb AS (SELECT b - a AS delta, row_number() OVER (ORDER BY contest_id) - 1 AS i, count(*) OVER () AS n FROM q),
dr AS (SELECT rep, CAST(floor({md5_uniform('7', 'rep', 'nb.i')} * n) AS BIGINT) AS i FROM nb, range(0, 2000) r(rep)),
mn AS (SELECT rep, avg(delta) AS m FROM dr JOIN nb ON nb.i = dr.i GROUP BY rep)
SELECT round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi, count(*) AS draws FROM mn"""


@query("a19_bootstrap_ci", _PAIR + _DRAWS, extra=SCORED)
def a19(spark, d):
    b = E.bootstrap_ci(E.contest_deltas(errors(spark, d), "average_speed", "last_slope"))
    return b.select(*[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "draws")


def snapshots(spark, d):
    return errors(spark, d).where("method = 'last_slope' and status = 'success' and actual is not null").withColumn("curve_mse", F.when(F.col("tier") > 100, F.col("ape") / 100))


SNAP = SCORED + ", sn AS (SELECT *, CASE WHEN tier > 100 THEN ape / 100 END AS curve_mse, (prediction - actual) / greatest(actual, 1) AS rel FROM er WHERE method = 'last_slope' AND status = 'success' AND actual IS NOT NULL)"


@query("a20_snapshot_metrics", """SELECT round(avg(rel * rel), 6) AS rel_mse, round(avg((ln(1 + greatest(prediction, 0)) - ln(1 + greatest(actual, 0))) ** 2),
  6) AS log_mse, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(abs(rel)), 6) AS mape, round(avg(curve_mse), 6) AS curve_mse, count(*) AS n,
  round(avg(rel * rel) + 0.5 * coalesce(avg(curve_mse), 0), 6) AS objective FROM sn""", extra=SNAP)
def a20(spark, d):
    m = E.snapshot_metrics(snapshots(spark, d))
    return m.select(*[c if c == "n" else F.round(c, 4 if c == "rmse" else 6).alias(c) for c in m.columns])


@query("a21_per_contest_summary", """SELECT contest_id, count(*) AS snapshots, round(avg(abs(rel)), 6) AS mean_abs_rel, round(avg(rel * rel), 6) AS rel_mse,
  round(sqrt(avg(error * error)), 4) AS rmse, round(avg(curve_mse), 6) AS curve_mse FROM sn GROUP BY 1""", extra=SNAP)
def a21(spark, d):
    m = E.per_contest_summary(snapshots(spark, d))
    return m.select("contest_id", "snapshots", *[F.round(c, 4 if c == "rmse" else 6).alias(c) for c in ("mean_abs_rel", "rel_mse", "rmse", "curve_mse")])


@query("a22_leaderboard", """SELECT method AS config_id, round(avg(CASE WHEN contest_id < 7 THEN mape END), 4) AS train, round(avg(CASE
  WHEN contest_id >= 7 AND method <> 'persistence' THEN mape END), 4) AS holdout, row_number() OVER (ORDER BY avg(CASE
  WHEN contest_id >= 7 AND method <> 'persistence' THEN mape END) NULLS LAST, method) AS rank FROM cm GROUP BY method""", extra=SCORED)
def a22(spark, d):
    m = E.hierarchical_metrics(errors(spark, d)).where("level = 'contest' and not (contest_id >= 7 and method = 'persistence')")
    losses = m.select(F.col("method").alias("config_id"), F.when(F.col("contest_id") < 7, "train").otherwise("holdout").alias("split"), F.col("mape").alias("objective"))
    return E.leaderboard(losses).select("config_id", F.round("train", 4).alias("train"), F.round("holdout", 4).alias("holdout"), F.col("rank").cast("long").alias("rank"))


@query("a23_deviation_stats", """SELECT count(*) AS n, round(avg(abs(error)), 4) AS mean, round(max(abs(error)), 4) AS max, round(min(abs(error)), 4) AS min,
  round(stddev_pop(abs(error)), 4) AS std FROM sn WHERE contest_id IN (SELECT DISTINCT contest_id FROM sn ORDER BY 1 DESC LIMIT 4)""", extra=SNAP)
def a23(spark, d):
    m = E.deviation_stats(snapshots(spark, d), 4)
    return m.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "max", "min", "std")])


@query("a25_coverage_gate", """WITH j AS (SELECT contest_id, contest_id IN (SELECT contest_id FROM tr) AS ok FROM contests) SELECT count(*) AS requested,
  count(*) FILTER (WHERE ok) AS included, CAST(greatest(3, ceil(count(*) * 0.6)) AS BIGINT) AS required, count(*) FILTER (WHERE ok) / count(*) AS share,
  count(*) FILTER (WHERE ok) >= greatest(3, ceil(count(*) * 0.6)) AS passed, coalesce(string_agg(CASE WHEN NOT ok THEN contest_id || '' END,
  ',' ORDER BY contest_id || ''), '') AS excluded FROM j""", extra=SCORED)
def a25(spark, d):
    c = A.contests(spark, d)
    return E.coverage_gate(c, G.final_truth(A.obs(spark, d), c, "bucket20"), 3, 0.6)


_SPLIT = """WITH c AS (SELECT contest_id, contest_type, row_number() OVER (ORDER BY contest_id) - 1 AS i, count(*) OVER () AS n FROM contests),
cuts AS (SELECT a.i, max(a.n) - a.i AS size, count(DISTINCT b.contest_type) = (SELECT count(DISTINCT contest_type) FROM contests) AS every_type, max(a.n) AS n
  FROM c a JOIN c b ON b.i >= a.i WHERE a.i > 0 AND a.n - a.i >= 2 GROUP BY a.i),
best AS (SELECT i FROM cuts ORDER BY every_type DESC, abs(size - greatest(2, round(n * 0.25))), i DESC LIMIT 1)
SELECT contest_id, contest_type, CASE WHEN i >= (SELECT i FROM best) THEN 'test' ELSE 'train' END AS split FROM c"""


@query("a28_time_split", _SPLIT)
def a28(spark, d):
    return E.time_split(A.contests(spark, d), 0.75, 2)


@query("a28_id_split", "SELECT contest_id, CASE WHEN contest_id >= 7 THEN 'holdout' ELSE 'train' END AS split FROM contests WHERE contest_id >= 7 OR contest_id BETWEEN 1 AND 5")
def a28_ids(spark, d):
    return E.id_split(A.contests(spark, d), 1, 5, 7).select("contest_id", "split")


@query("j10_paired_support", """SELECT a.contest_id, a.tier, a.origin_h, a.method, a.prediction FROM er a SEMI JOIN (SELECT * FROM er
  WHERE method = 'last_slope' AND status = 'success') b ON a.contest_id = b.contest_id AND a.tier = b.tier AND a.origin_h = b.origin_h WHERE a.method = 'persistence'""", extra=SCORED)
def j10(spark, d):
    return J.paired_support(errors(spark, d), "persistence", "last_slope").select(*K, F.col("origin_h").cast("long").alias("origin_h"), "method", "prediction")


_DRAWN = "round(least(hi, greatest(lo, round_even((lo + (hi - lo) * {u}) * 4, 0) / 4)), 4)"
PLAN = f""", tt AS (SELECT contest_id, (end_at - start_at) / 3600000.0::DOUBLE AS total FROM contests),
bk AS (SELECT contest_id, bucket, greatest(18.0, lo * total) AS lo, least(hi * total, greatest(18.0, 0.9 * total)) AS hi
  FROM tt, (VALUES {", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(E.BUCKETS))}) b(bucket, lo, hi)),
pl AS (SELECT contest_id, bucket, {_DRAWN.format(u=md5_uniform("7", "contest_id", "bucket"))} AS hour FROM bk WHERE hi > lo
  UNION ALL SELECT contest_id, -1, round(least(greatest(18.0, 0.9 * total), greatest(18.0, 0.5 * total)), 4) FROM tt WHERE contest_id NOT IN (SELECT contest_id FROM bk WHERE hi > lo)),
sp AS (SELECT contest_id, min(bucket) AS bucket, hour FROM pl GROUP BY contest_id, hour)"""
_CHECKS = f"""WITH ck AS (SELECT sp.*, j, greatest(0.5, lo * (total - hour)) + hour AS lo, least(total, hour + hi * (total - hour)) AS hi
  FROM sp JOIN tt ON tt.contest_id = sp.contest_id, (VALUES {", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(E.CURVE_BUCKETS))}) b(j, lo, hi) WHERE total > hour + 1),
ok AS (SELECT *, row_number() OVER (PARTITION BY contest_id, bucket ORDER BY j) - 1 AS r, count(*) OVER (PARTITION BY contest_id, bucket) AS m FROM ck WHERE hi > lo),
dn AS (SELECT contest_id, bucket, hour, t.n AS "check", {_DRAWN.format(u=md5_uniform("8", "contest_id", "bucket", "t.n"))} AS check_hour FROM ok, (VALUES (0), (1), (2)) t(n) WHERE t.n % m = r)
SELECT contest_id, bucket, hour, min("check") AS "check", check_hour FROM dn GROUP BY contest_id, bucket, hour, check_hour"""


@query("e1_snapshot_plan", "SELECT contest_id, bucket, hour FROM sp", extra=PLAN)
def e1(spark, d):
    return E.snapshot_plan(A.contests(spark, d))


@query("e2_curve_check_hours", _CHECKS, extra=PLAN)
def e2(spark, d):
    c = A.contests(spark, d)
    return E.curve_check_hours(E.snapshot_plan(c), c)


@query("e7_screen_candidates", """WITH e AS (SELECT * FROM er WHERE actual <> 0 AND NOT (method = 'average_speed' AND tier = 50 AND contest_id % 2 = 0 AND origin_h = 24)),
p AS (SELECT count(*) AS planned FROM (SELECT DISTINCT contest_id, tier, origin_h FROM e)), k AS (SELECT * FROM e WHERE status = 'success' AND ape IS NOT NULL),
c1 AS (SELECT contest_id, tier, method, avg(ape) AS m, count(*) AS n FROM k GROUP BY ALL), c2 AS (SELECT contest_id, method, avg(m) AS m, sum(n) AS n
  FROM c1 GROUP BY ALL), c3 AS (SELECT method, avg(m) AS m, CAST(sum(n) AS BIGINT) AS n FROM c2 GROUP BY 1), f AS (SELECT method FROM c3, p WHERE n = planned ORDER BY m, method LIMIT 1)
SELECT method, round(m, 4) AS mape, n AS rows, planned, method IN (SELECT method FROM f) AS chosen FROM c3, p""", extra=SCORED)
def e7(spark, d):
    """One candidate lacks some forecasts: it cannot be chosen, whatever its errors."""
    lacking = "method = 'average_speed' and tier = 50 and contest_id % 2 = 0 and origin_h = 24"
    return E.screen_candidates(errors(spark, d).where(f"not ({lacking})")).withColumn("mape", F.round("mape", 4))


_BROKEN = """WITH s AS (SELECT contest_id, tier, origin_h, method, prediction, CASE WHEN contest_id = 5 AND method = 'persistence' THEN 'failed' ELSE status END AS status,
  CASE WHEN prediction IS NULL THEN 'no_forecast' END AS reason FROM er WHERE NOT (contest_id = 4 AND method = 'persistence') AND NOT (contest_id = 6 AND tier = 50 AND origin_h = 24)),
t AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE contest_id = 7 AND method = 'last_slope'),
o AS (SELECT contest_id, tier, list_sort(list_distinct(list(origin_h))) AS o FROM t GROUP BY ALL)
SELECT 'duplicate' AS "check", contest_id, tier, origin_h FROM t GROUP BY contest_id, tier, origin_h, method HAVING count(*) > 1
UNION ALL SELECT 'method_missing', contest_id, tier, origin_h FROM t GROUP BY contest_id, tier, origin_h HAVING count(DISTINCT method) < 3
UNION ALL SELECT 'status_mismatch', contest_id, tier, origin_h FROM t WHERE CASE WHEN status = 'success' THEN prediction IS NULL ELSE prediction IS NOT NULL OR reason IS NULL END
UNION ALL SELECT 'origins_differ', contest_id, NULL, NULL FROM o GROUP BY contest_id HAVING count(DISTINCT o) > 1"""


@query("e8_scoring_row_checks", _BROKEN, extra=SCORED)
def e8(spark, d):
    """Scoring rows that were broken on purpose, in four ways."""
    s = scored(spark, d).where("not (contest_id = 4 and method = 'persistence') and not (contest_id = 6 and tier = 50 and origin_h = 24)")
    s = s.withColumn("status", F.when((F.col("contest_id") == 5) & (F.col("method") == "persistence"), "failed").otherwise(F.col("status")))
    s = s.unionByName(s.where("contest_id = 7 and method = 'last_slope'"))
    return E.scoring_row_checks(s, METHODS).withColumn("origin_h", F.col("origin_h").cast("long"))


@query("cleaned_normalised_speeds", """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, tier, time_ms ORDER BY available_at DESC,
  seq DESC) AS r FROM dirty WHERE score >= 0 AND tier <> 999) WHERE r = 1),
s AS (SELECT contest_id, tier, time_ms, greatest(0.0, coalesce((score - lag(score) OVER k) / nullif((time_ms - lag(time_ms) OVER k) / 60000.0, 0), 0)) AS speed FROM r
  WINDOW k AS (PARTITION BY contest_id, tier ORDER BY time_ms))
SELECT contest_id, tier, count(*) AS n, round(avg(speed / scale), 6) AS mean_norm FROM s JOIN scales USING (contest_id) GROUP BY ALL""", speed=True)
def cleaned(spark, d):
    o, _ = C.validate_tiers(C.usable(A.obs_dirty(spark, d)))
    return S.attach_scale(S.interval_speed(S.latest_revision(o)), scales(spark, d)).groupBy(*K).agg(F.count("*").alias("n"), F.round(F.avg("norm_speed"), 6).alias("mean_norm"))
