"""Replays of forecasts: each (contest, origin) stands as a contest of its own, a run, so that an operator sees its prefix and nothing later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.operators import aggregates as G
from podium.operators import clean as C
from podium.operators import evaluate as E
from podium.operators import joins as J
from podium.operators import models as M
from podium.operators import series as S
from podium.plans import adapters as A
from podium.plans.aggregate_queries import normalised, profile
from podium.plans.series_queries import canonical, scales
from podium.schema import DEFAULTS, HOUR_MS, K
from podium.session import cut

#: A run's id is contest_id * RUN + its origin in ten-thousandths of an hour.
RUN, PER_HOUR = 1 << 24, 10_000
METHODS = ("pace", "cohort", "skeleton", "persistence", "last_slope", "average_speed")


def total_h():
    return (F.col("end_at") - F.col("start_at")) / float(HOUR_MS)


def daily(spark, d) -> DataFrame:
    """(contest_id, origin_h, origin_ms) every 24 hours."""
    return S.daily_origins(A.contests(spark, d)).withColumn("origin_h", F.col("origin_h").cast("double"))


def planned(spark, d) -> DataFrame:
    """The same at the snapshots of the plan."""
    c = A.contests(spark, d)
    j = E.snapshot_plan(c).join(c.select("contest_id", "start_at"), "contest_id")
    return j.select("contest_id", F.col("hour").alias("origin_h"), (F.col("start_at") + F.col("hour") * HOUR_MS).cast("long").alias("origin_ms"))


def runs(contests: DataFrame, origins: DataFrame) -> DataFrame:
    """(of, contest_id, origin_h, origin_ms, start_at, end_at, aggregate_at, contest_type): contest_id is the run's."""
    r = origins.join(contests, "contest_id").withColumn("of", F.col("contest_id"))
    return r.withColumn("contest_id", F.col("of") * RUN + F.round(F.col("origin_h") * PER_HOUR).cast("long"))


def seen_by(rows: DataFrame, r: DataFrame) -> DataFrame:
    """rows (with time_ms or else hours) of each run's contest up to its origin, under the run's id."""
    j = rows.withColumnRenamed("contest_id", "of").join(r.select("of", "contest_id", "origin_h", "origin_ms"), "of")
    return j.where("time_ms <= origin_ms" if "time_ms" in rows.columns else "hours <= origin_h").drop("of", "origin_h", "origin_ms")


def unrun(df: DataFrame) -> DataFrame:
    """df with the contest's id and origin_h in place of the run's id."""
    return df.withColumns({"origin_h": F.col("contest_id").bitwiseAND(RUN - 1) / float(PER_HOUR), "contest_id": F.shiftright("contest_id", 24)})


def causal_history(spark, d, k: int = 3) -> DataFrame:
    return J.select_history(A.contests(spark, d), scales(spark, d), k, (2,), mode="causal")


def skeleton_inputs(spark, d, r: DataFrame, config: dict = DEFAULTS) -> dict:
    """What skeleton_paths needs of runs and shares between configurations of one weekend_multiplier."""
    c, f = A.contests(spark, d), cut(G.season_factors(profile(spark, d), config["weekend_multiplier"]))
    old = cut(G.attach_season_factor(normalised(spark, d), f))
    scale = cut(G.scale_from_points(seen_by(A.points(spark, d), r)))
    rows = C.elapsed_and_phase(seen_by(A.obs(spark, d), r), r.drop("of", "origin_h", "origin_ms"))
    ends = r.select("of", F.col("contest_id").alias("target_id"), "origin_h", total_h().alias("target_hours"))
    hist = causal_history(spark, d).withColumnRenamed("target_id", "of").join(ends, "of").join(c.select("contest_id", total_h().alias("history_hours")), "contest_id")
    return {
        "factors": f, "old": old, "scale": scale, "new": cut(G.attach_season_factor(S.attach_scale(S.interval_speed(rows), scale), f)), "ends": cut(ends), "history": cut(hist),
        "fits": cut(M.fit_skeleton(old, c)), "tiers": cut(A.obs(spark, d).select(*K).distinct()), "seen": cut(seen_by(canonical(spark, d), r)), "weekend_multiplier": config["weekend_multiplier"],
    }


def skeleton_paths(spark, d, r: DataFrame, config: dict = DEFAULTS, inputs: dict | None = None) -> DataFrame:
    """skeleton_path of each run: its own rows, scale, ratio and refit up to the origin, from causal histories.

    The hourly profile is one table for all contests, as it is for the other queries.
    """
    x = inputs if inputs and inputs["weekend_multiplier"] == config["weekend_multiplier"] else skeleton_inputs(spark, d, r, config)
    t1 = F.least(F.col("origin_h"), F.greatest(F.lit(float(config["t_end_cap"])), F.col("target_hours") - 24))
    window = x["ends"].select("target_id", F.lit(float(config["t_start_cmp"])).alias("t0"), t1.alias("t1"))
    hist = x["history"].join(window, "target_id").select("target_id", "contest_id", "target_hours", "history_hours", "t0", "t1")
    stats = G.blended_window_stats(hist.join(x["tiers"], "contest_id"), x["old"].select(*K, "hours", "norm_speed", "skeleton_speed"), config)
    own = x["new"].join(window.withColumnRenamed("target_id", "contest_id"), "contest_id")
    t = own.groupBy(*K).agg(F.max("hours").alias("observed_h")).join(G.window_intensity(own, K), K, "left").join(G.window_mean(own, "norm_speed", K, "norm_mean"), K, "left")
    ratio = G.strength_ratio(t.withColumnRenamed("contest_id", "target_id"), stats, config)
    mean = hist.join(x["fits"], "contest_id").groupBy("target_id", "tier").agg(*[F.avg(p).alias(p) for p in M.PARAMS], F.avg("history_hours").alias("history_h"), F.max("target_hours").alias("target_h"))
    p = M.align_duration(mean.join(ratio, ["target_id", "tier"]), config).withColumnRenamed("target_id", "contest_id").withColumn("total_h", F.col("target_h"))
    p = M.refit_local(S.refit_window(x["new"], config), p.select(*K, *M.PARAMS, "total_h"), config)
    return M.skeleton_path(cut(p), x["seen"], r.drop("of", "origin_h", "origin_ms"), x["scale"], x["factors"], config)


def scored(spark, d, pace_prior: DataFrame, templates: DataFrame, knots, pressure: DataFrame) -> DataFrame:
    """Scoring rows of every (contest, tier, daily origin, method): (.., status, reason, prediction, actual); the truth is joined last.

    knots: a function from runs to the knots of forecast_cohort.
    """
    c, o = A.contests(spark, d), A.obs(spark, d)
    r = cut(runs(c, daily(spark, d)))
    at = r.select(F.col("of").alias("contest_id"), "origin_h", "origin_ms")
    seen = cut(seen_by(canonical(spark, d), r))
    of = lambda df, m, p="final": df.select(*K, "origin_h", F.lit(m).alias("method"), F.col(p).alias("prediction"))
    f = of(M.forecast_pace(unrun(seen), pace_prior, c, pressure), "pace")
    f = f.unionByName(of(M.forecast_cohort(knots(r), templates, c), "cohort")).unionByName(of(unrun(M.path_end(skeleton_paths(spark, d, r))), "skeleton"))
    naive = S.baseline_forecasts(S.prefix_join(S.last_rows(o, at), at), c)
    for m in METHODS[3:]:
        f = f.unionByName(of(naive, m, m))
    first_end = c.agg(F.min("end_at")).first()[0]
    began = c.where(F.col("start_at") > F.lit(first_end)).select("contest_id")
    able = began.crossJoin(F.broadcast(spark.createDataFrame([("pace",), ("cohort",)], "method string"))).unionByName(causal_history(spark, d).select(F.col("target_id").alias("contest_id"), F.lit("skeleton").alias("method")).distinct())
    return scoring_rows(o, c, at, f, METHODS, able)


def scoring_rows(o: DataFrame, c: DataFrame, at: DataFrame, forecasts: DataFrame, methods: tuple, able: DataFrame | None = None, reasons: DataFrame | None = None) -> DataFrame:
    """Every (contest, tier, origin, method) with its forecast, or failed and why; the truth is joined last, so no forecast sees it.

    able: (contest_id, method) with histories to learn from; the first three methods without them say no_history.
    reasons: (contest_id, tier, origin_h, why) of prefixes that no method here may forecast.
    """
    n = S.prefix_totals(o, at).select(*K, "origin_h", "rows")
    grid = o.select(*K).distinct().join(at.select("contest_id", "origin_h"), "contest_id").withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    j = grid.join(forecasts, [*K, "origin_h", "method"], "left").join(n, [*K, "origin_h"], "left")
    ok = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    why = F.when(F.col("rows").isNull(), "no_rows")
    if able is not None:
        j = j.join(able.withColumn("able", F.lit(True)), ["contest_id", "method"], "left")
        why = why.when(F.col("method").isin(*methods[:3]) & F.col("able").isNull(), "no_history")
    if reasons is not None:
        j = j.join(reasons.select(*K, "origin_h", "why"), [*K, "origin_h"], "left")
        why = why.when(F.col("why").isNotNull(), F.col("why"))
    j = j.select(*K, "origin_h", "method", F.when(ok, F.col("prediction")).alias("prediction"), F.when(ok, "success").otherwise("failed").alias("status"), F.when(~ok, why.otherwise("no_forecast")).alias("reason"))
    return E.error_metrics(j.join(G.final_truth(o, c, "bucket20").select(*K, "actual"), K, "left"))


def checks(spark, d) -> DataFrame:
    """(contest_id, tier, run, check_hour, actual_at): the curve checks of each planned run on all tiers of its contest, with the score there."""
    c = A.contests(spark, d)
    h = E.curve_check_hours(E.snapshot_plan(c), c).select("contest_id", (F.col("contest_id") * RUN + F.round(F.col("hour") * PER_HOUR).cast("long")).alias("run"), "check", F.col("check_hour").alias("hours"))
    s = cut(canonical(spark, d))
    return S.lookup_curve(s.select(*K).distinct().join(h, "contest_id").select(*K, "hours", "run", "check"), s, out="actual_at").withColumnRenamed("hours", "check_hour")


def snapshots(spark, d, k: int = 3, config: dict = DEFAULTS, shared: dict | None = None) -> DataFrame:
    """(contest_id, tier, origin_h, status, prediction, actual, curve_mse): skeleton forecasts at every planned snapshot; skipped with under three rows or k histories."""
    c, o = A.contests(spark, d), A.obs(spark, d)
    r = shared["runs"] if shared else cut(runs(c, planned(spark, d)))
    path = cut(skeleton_paths(spark, d, r, config, shared))
    w = W.partitionBy(*K).orderBy("hours").rowsBetween(W.unboundedPreceding, 0)
    ahead = path.where("hours >= now_h").select(*K, "hours", (F.col("score_now") + F.sum("gain").over(w)).alias("score"))
    curve = ahead.unionByName(path.groupBy(*K).agg(F.max("now_h").alias("hours"), F.max("score_now").alias("score"))).groupBy(*K, "hours").agg(F.max("score").alias("score"))
    at = (shared["checks"] if shared else checks(spark, d)).select(F.col("run").alias("contest_id"), "tier", F.col("check_hour").alias("hours"), "actual_at")
    rel = (F.col("predicted_at") - F.col("actual_at")) / F.greatest(F.col("actual_at"), F.lit(1.0))
    mse = S.lookup_curve(at, curve, out="predicted_at").groupBy(*K).agg(F.avg(rel * rel).alias("curve_mse"))
    few = seen_by(o, r).groupBy(*K).agg(F.count("*").alias("rows"))
    enough = causal_history(spark, d, k).groupBy(F.col("target_id").alias("of")).agg(F.count("*").alias("histories"))
    grid = o.select(F.col("contest_id").alias("of"), "tier").distinct().join(r.select("of", "contest_id"), "of").join(enough, "of", "left").drop("of")
    j = grid.join(M.path_end(path).select(*K, F.col("final").alias("prediction")), K, "left").join(mse, K, "left").join(few, K, "left")
    ok = F.col("prediction").isNotNull() & (F.coalesce("rows", F.lit(0)) >= 3) & (F.coalesce("histories", F.lit(0)) >= k)
    j = j.select(*K, F.when(ok, F.col("prediction")).alias("prediction"), F.when(ok, F.col("curve_mse")).alias("curve_mse"), F.when(ok, "success").otherwise("skipped").alias("status"))
    return unrun(j).join(G.final_truth(o, c, "last").select(*K, "actual"), K, "left")  # joined last: no forecast sees it
