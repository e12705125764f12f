"""Scales, profiles, window statistics, rewards and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.operators.clean import local_time, profile_window, with_day_type
from podium.operators.moments import window_statistics
from podium.operators.quantiles import exact_quantiles
from podium.schema import DEFAULTS, GRACE_MS, HOUR_MS, K
from podium.session import cut


def _top_three(speeds: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Mean of the three largest speeds of each key; the three of each (key, tie) are taken first, so a hot key has few rows."""
    keep = speeds.where("speed > 0 and speed < 1e6")
    first = keep.withColumn("__r", F.row_number().over(W.partitionBy(*keys, tie).orderBy(F.desc("speed")))).where("__r <= 3")
    last = first.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("speed"), tie))).where("__r <= 3")
    return last.groupBy(*keys).agg(F.avg("speed").alias("scale"))


def scale_from_points(points: DataFrame, origins: DataFrame | None = None, first_n: int | None = None) -> DataFrame:
    """(contest_id[, origin_ms], scale): the top players' speed, in points a minute.

    origins: (contest_id, origin_ms) cut first, with one scale for each; first_n keeps the first arrivals of each
    contest (or origin).
    """
    keys = ["contest_id"]
    if origins is not None:
        points, keys = points.join(origins.select("contest_id", "origin_ms"), "contest_id").where("time_ms <= origin_ms"), ["contest_id", "origin_ms"]
    if first_n:
        points = points.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).where(F.col("__r") <= first_n)
    w = W.partitionBy(*keys, "uid").orderBy("time_ms", "seq")
    speed = F.try_divide(F.col("value") - F.lag("value").over(w), (F.col("time_ms") - F.lag("time_ms").over(w)) / 60000.0)
    return _top_three(points.select(*keys, "uid", speed.alias("speed")), keys, "uid")


def scale_from_tracker(obs: DataFrame, tier: int = 10, origins: DataFrame | None = None) -> DataFrame:
    """The same over one tier's series; with origins (contest_id, origin_h, origin_ms) one scale for each, null with under two visible rows."""
    w = W.partitionBy("contest_id").orderBy("time_ms", "seq")
    speed = F.try_divide(F.col("score") - F.lag("score").over(w), (F.col("time_ms") - F.lag("time_ms").over(w)) / 60000.0)
    rows = obs.where(F.col("tier") == tier).select("contest_id", "time_ms", speed.alias("speed"))
    if origins is None:
        return _top_three(rows, ["contest_id"], "time_ms")
    scaled = _top_three(rows.join(origins, "contest_id").where("time_ms <= origin_ms"), ["contest_id", "origin_h"], "time_ms")
    return origins.select("contest_id", "origin_h").join(scaled, ["contest_id", "origin_h"], "left")


def hourly_speed_profile(rows: DataFrame, exact: bool = True) -> DataFrame:
    """(day_type, hour, mean, median, std, cnt) of norm_speed: the full grid of 48 rows. Exact medians take a second pass (quantiles.exact_quantiles); exact=False leaves it at percentile_approx."""
    keys = ["day_type", "hour"]
    typed = with_day_type(rows)
    of = [F.avg("norm_speed").alias("mean"), F.stddev_pop("norm_speed").alias("std"), F.count("*").alias("cnt")]
    if exact:
        typed = cut(typed.select(*keys, "norm_speed"))
        g = typed.groupBy(*keys).agg(*of).join(exact_quantiles(typed, keys, "norm_speed", {"median": 0.5}).drop("n"), keys, "left")
    else:
        g = typed.groupBy(*keys).agg(*of, F.percentile_approx("norm_speed", 0.5, 10_000).alias("median"))
    grid = rows.sparkSession.range(48).select(F.when(F.col("id") < 24, "weekday").otherwise("weekend").alias("day_type"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(g, keys, "left").select(*keys, "mean", "median", "std", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def contest_profile(rows: DataFrame, tier: int = 1000, min_scale: float = 100.0, after_start: int = 24, before_end: int = 48, exact: bool = True) -> DataFrame:
    """hourly_speed_profile of one tier's speeds in the middle of contests of a scale worth it; rows have start_at, end_at, scale and norm_speed."""
    kept = rows.where((F.col("tier") == tier) & (F.col("scale") >= min_scale) & ~F.isnan("norm_speed"))
    return hourly_speed_profile(profile_window(kept, after_start, before_end), exact)


def profile_means(profile: DataFrame, weekend_multiplier: float = DEFAULTS["weekend_multiplier"]) -> DataFrame:
    """One row (weekday_mean, weekend_mean, global_mean): weekend means are multiplied first; hours of no positive mean don't count."""
    m = F.when(F.col("day_type") == "weekend", F.col("mean") * weekend_multiplier).otherwise(F.col("mean"))
    p = profile.withColumn("m", m).where("m > 0")
    one = lambda t: F.coalesce(F.avg(F.when(F.col("day_type") == t, F.col("m"))), F.lit(1.0))
    return p.agg(one("weekday").alias("weekday_mean"), one("weekend").alias("weekend_mean")).withColumn("global_mean", (5 * F.col("weekday_mean") + 2 * F.col("weekend_mean")) / 7)


def season_factors(profile: DataFrame, weekend_multiplier: float = DEFAULTS["weekend_multiplier"]) -> DataFrame:
    """(day_type, hour, factor): mean / global mean, 1 where there is no positive mean."""
    m = F.when(F.col("day_type") == "weekend", F.col("mean") * weekend_multiplier).otherwise(F.col("mean"))
    means = profile_means(profile, weekend_multiplier)
    return profile.crossJoin(F.broadcast(means)).select("day_type", "hour", F.when(m > 0, m / F.col("global_mean")).otherwise(1.0).alias("factor"))  # 48 rows and one


def attach_season_factor(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """`factor` by local day type and hour (1 within the first 12 hours if below 1), and `skeleton_speed` = norm_speed / factor."""
    j = with_day_type(rows).join(F.broadcast(factors), ["day_type", "hour"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    j = j.withColumn("factor", F.when((F.col("hours") < 12) & (F.col("factor") < 1), 1.0).otherwise(F.col("factor")))
    return j.withColumn("skeleton_speed", F.col("norm_speed") / F.col("factor"))


def window_mean(rows: DataFrame, column: str, keys: list[str], out: str = "window_mean") -> DataFrame:
    """Mean of a column over rows with t0 <= hours <= t1 (columns of rows)."""
    return rows.where((F.col("hours") >= F.col("t0")) & (F.col("hours") <= F.col("t1")) & F.col(column).isNotNull() & ~F.isnan(column)).groupBy(*keys).agg(F.avg(column).alias(out))


def window_intensity(rows: DataFrame, keys: list[str], out: str = "intensity") -> DataFrame:
    """Mean skeleton speed in the window; with a sample deviation above 0.001, of the rows within two of it, if there are any."""
    r = rows.where("hours >= t0 and hours <= t1 and skeleton_speed is not null and not isnan(skeleton_speed)")
    w = W.partitionBy(*keys)
    r = r.withColumns({"__m": F.avg("skeleton_speed").over(w), "__s": F.stddev_samp("skeleton_speed").over(w)})
    inner = F.avg(F.when(F.abs(F.col("skeleton_speed") - F.col("__m")) < 2 * F.col("__s"), F.col("skeleton_speed")))
    return r.groupBy(*keys).agg(F.when(F.max("__s") > 0.001, F.coalesce(inner, F.max("__m"))).otherwise(F.max("__m")).alias(out))


def duration_weight(source_h: Column, reference_h: Column, most: float, config: dict = DEFAULTS) -> Column:
    """0 to `most` by how far two durations differ on the logarithmic scale; 0 if one, or a setting, is not positive."""
    if config["duration_align_log_full_weight"] <= 0 or most <= 0:
        return F.lit(0.0)
    gap = F.least(F.abs(F.ln(source_h / reference_h)) / config["duration_align_log_full_weight"], F.lit(1.0))
    return F.when((source_h > 0) & (reference_h > 0), F.least(gap * most, F.lit(most))).otherwise(0.0)


def blended_window_stats(pairs: DataFrame, history: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(target_id, contest_id, tier, intensity, norm_mean): a history's window statistics, by hours and by progress, blended by the difference of durations.

    pairs: (target_id, target_hours, contest_id, history_hours, tier, t0, t1); history: rows with hours, norm_speed, skeleton_speed.
    A history's rows are not repeated for its targets (moments.window_statistics).
    """
    keys = ["target_id", *K]
    p = pairs.withColumn("w", duration_weight(F.col("target_hours"), F.col("history_hours"), config["duration_window_align_max_weight"], config))
    mapped = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(t) / F.col("target_hours"))) * F.col("history_hours")
    window = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    by_hours, by_progress = window("hours", F.col("t0"), F.col("t1")), window("progress", mapped("t0"), mapped("t1"))
    windows = p.select(*keys, F.explode(F.when(F.col("w") > 0, F.array(by_hours, by_progress)).otherwise(F.array(by_hours))).alias("k")).select(*keys, "k.*")
    g = window_statistics(history, windows, ["target_id", "kind"])
    of = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    g = g.groupBy(*keys).agg(*[of(c, kind).alias(f"{c[0]}_{kind}") for c in ("intensity", "norm_mean") for kind in ("hours", "progress")])
    blend = lambda x: F.when(F.col("w") <= 0, F.col(f"{x}_hours")).otherwise(F.coalesce((1 - F.col("w")) * F.col(f"{x}_hours") + F.col("w") * F.col(f"{x}_progress"), F.col(f"{x}_hours"), F.col(f"{x}_progress")))
    return p.select(*keys, "w").join(g, keys, "left").select(*keys, blend("i").alias("intensity"), blend("n").alias("norm_mean"))


def strength_ratio(targets: DataFrame, stats: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(target_id, tier, ratio): how strong a target is against its histories.

    targets: (target_id, tier, intensity, norm_mean, observed_h); stats: blended_window_stats. 1 where an intensity is missing.
    """
    h = stats.groupBy("target_id", "tier").agg(F.avg("intensity").alias("h_int"), F.avg("norm_mean").alias("h_norm"))
    j = targets.join(h, ["target_id", "tier"], "left")
    skeleton = F.when(F.col("h_int") > 0, F.col("intensity") / F.col("h_int")).otherwise(1.0)
    norm = F.when(F.col("h_norm") > 0, F.coalesce("norm_mean", F.lit(0.0)) / F.col("h_norm")).otherwise(1.0)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("observed_h") / config["t_end_cap"]))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 + 0.6 * F.cos((s - 1) * F.pi())))
    ratio = F.greatest(F.lit(config["ratio_min"]), F.least(F.lit(config["ratio_max"]), skeleton * (1 - w) + norm * w))
    return j.select("target_id", "tier", F.when(F.col("intensity").isNull() | F.col("h_int").isNull(), 1.0).otherwise(ratio).alias("ratio"))


#: Rewards that every rank has.
PLAIN_REWARDS = ("item", "practice_ticket", "star", "degree", "bili_degree_effect")


def special_reward_tiers(rewards: DataFrame) -> DataFrame:
    """(contest_id, last_appearance map, targets array): the last rank of each special reward, and the distinct ranks."""
    r = rewards.where(F.coalesce("reward_type", F.lit("")) != "").where(~F.col("reward_type").isin(*PLAIN_REWARDS))
    key = F.when(F.col("reward_id").isNull(), F.col("reward_type")).otherwise(F.concat_ws(":", "reward_type", F.col("reward_id").cast("string")))
    last = r.groupBy("contest_id", key.alias("key")).agg(F.max("to_rank").alias("rank"))
    return last.groupBy("contest_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "rank")))).alias("last_appearance"), F.sort_array(F.collect_set("rank")).alias("targets"))


def reward_class_ranks(rewards: DataFrame) -> DataFrame:
    """(contest_id, reward_class, rank, ambiguous): deco_pins, and voice stamps from id 10000 on as premium, else standard; several ranks are ambiguous (rank null)."""
    cls = F.when(F.col("reward_type") == "deco_pins", "deco_pins").when((F.col("reward_type") == "voice_stamp") & (F.col("reward_id") >= 10_000), "premium").when((F.col("reward_type") == "voice_stamp") & F.col("reward_id").isNotNull(), "standard")
    g = rewards.withColumn("reward_class", cls).where("reward_class is not null").groupBy("contest_id", "reward_class").agg(F.count_distinct("to_rank").alias("n"), F.max("to_rank").alias("rank"))
    return g.select("contest_id", "reward_class", F.when(F.col("n") == 1, F.col("rank")).alias("rank"), (F.col("n") > 1).alias("ambiguous"))


def tier_quality_report(obs: DataFrame, origins: DataFrame, tiers: DataFrame) -> DataFrame:
    """Counts for each (contest_id, origin_ms, tier) of the grid origins x tiers, in the order of the cuts: validity, origin, availability, repeated times, falls.

    obs without a column available_at is judged by time alone, with response_at (if there is such a column) as
    the time of the whole response. status: ok, missing, invalid_schema (a tier whose rows have no time, or no
    score, at all) or no_usable_as_of_records. availability: explicit_row_level, explicit_response_level,
    degraded_partial_row_level_available_at (some rows lack it and are left out), unknown_degraded_timestamp_only, or
    unknown_degraded_missing_tier.
    """
    keys = ["contest_id", "origin_ms", "tier"]
    at = origins.select("contest_id", "origin_ms").distinct()
    grid = at.crossJoin(F.broadcast(tiers.select("tier")))  # 24 tiers at most
    by_row, by_response = "available_at" in obs.columns, "response_at" in obs.columns
    optional = lambda c, there: F.col(c) if there else F.lit(None).cast("long").alias(c)
    r = obs.select(*K, "time_ms", "score", optional("available_at", by_row), optional("response_at", by_response), "seq").join(at, "contest_id")
    bad_t, bad_v = F.coalesce(F.col("time_ms") < 0, F.lit(True)), F.coalesce((F.col("score") < 0) | F.isnan("score"), F.lit(True))
    r = r.withColumns({"bt": bad_t, "bv": bad_v, "late": ~bad_t & ~bad_v & (F.col("time_ms") > F.col("origin_ms"))})
    r = r.withColumn("seen", ~F.col("bt") & ~F.col("bv") & ~F.col("late"))
    known = F.col("available_at") if by_row else F.col("response_at")
    r = r.withColumns({"unknown": F.col("seen") & F.lit(by_row) & known.isNull(), "future": F.col("seen") & F.coalesce(known > F.col("origin_ms"), F.lit(False))})
    r = r.withColumn("ok", F.col("seen") & ~F.col("unknown") & ~F.col("future"))
    w = W.partitionBy(*keys, "ok", "time_ms")
    r = r.withColumns({"same": F.count("*").over(w), "newest": F.row_number().over(w.orderBy(F.desc("available_at"), F.desc("seq")))})
    r = r.withColumn("one", F.col("ok") & (F.col("newest") == 1))
    r = r.withColumn("falls", F.col("one") & F.coalesce(F.col("score") < F.lag("score").over(W.partitionBy(*keys, "one").orderBy("time_ms")), F.lit(False)))
    g = r.groupBy(*keys).agg(
        F.count("*").alias("raw_rows"), F.count_if("bt").alias("invalid_time"), F.count_if("bv").alias("invalid_value"), F.count_if("late").alias("post_origin"), F.count_if("unknown").alias("unknown_available"),
        F.count_if("future").alias("future_available"), F.count_if(F.col("ok") & (F.col("same") > 1)).alias("duplicate_rows"), F.count_if("falls").alias("falls"), F.count_if("one").alias("usable"),
        (F.count("time_ms") * F.count("score") == 0).alias("no_column"), F.count("response_at").alias("responses"),
    )
    out = grid.join(g, keys, "left")
    status = F.when(F.col("raw_rows").isNull(), "missing").when(F.col("no_column"), "invalid_schema").when(F.col("usable") == 0, "no_usable_as_of_records").otherwise("ok")
    explicit = F.when(F.col("unknown_available") > 0, "degraded_partial_row_level_available_at").otherwise("explicit_row_level")
    response = F.when(F.col("responses") > 0, "explicit_response_level").otherwise("unknown_degraded_timestamp_only")
    availability = F.when(F.col("raw_rows").isNull(), "unknown_degraded_missing_tier").otherwise(explicit if by_row else response)
    counts = [c for c in g.columns if c not in (*keys, "no_column", "responses")]
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], status.alias("status"), availability.alias("availability"))


def quality_rollup(report: DataFrame) -> DataFrame:
    """Per contest and origin: sums, observed and missing tiers, the observed share, and whether all that was used had a known time of availability."""
    sums = [F.sum(c).alias(c) for c in ("raw_rows", "usable", "post_origin", "duplicate_rows", "falls")]
    missing = F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("tier"))))
    g = report.groupBy("contest_id", "origin_ms").agg(*sums, F.count_if(F.col("status") == "ok").alias("observed"), F.count("*").alias("requested"), missing.alias("missing"), F.count_if(~F.col("availability").startswith("explicit")).alias("__odd"))
    availability = F.when(F.col("__odd") > 0, "degraded_timestamp_only").otherwise("explicit_available_at")
    return g.withColumns({"completeness": F.col("observed") / F.col("requested"), "availability": availability}).drop("__odd")


def contest_cache_index(obs: DataFrame, scales: DataFrame, contests: DataFrame, tier: int) -> DataFrame:
    """(contest_id, contest_type, record_count, final_score, scale) over one tier's series."""
    g = obs.where(F.col("tier") == tier).groupBy("contest_id").agg(F.count("*").alias("record_count"), F.max_by("score", F.struct("time_ms", "seq")).alias("final_score"))
    return g.join(contests.select("contest_id", "contest_type"), "contest_id").join(scales, "contest_id", "left").select("contest_id", "contest_type", "record_count", "final_score", "scale")


def final_truth(obs: DataFrame, contests: DataFrame, rule: str = "first_post_end") -> DataFrame:
    """(contest_id, tier, actual, ambiguous): the score of the first row after the end (bucket20: within 20 minutes), or the last row's (last). Several rows at that time are ambiguous."""
    rows = obs.join(contests.select("contest_id", "end_at"), "contest_id")
    if rule == "last":
        return rows.groupBy(*K).agg(F.max_by("score", F.struct("time_ms", "seq")).alias("actual")).withColumn("ambiguous", F.lit(False))
    rows = rows.where("time_ms > end_at")
    rows = rows.where(F.col("time_ms") <= F.col("end_at") + GRACE_MS) if rule == "bucket20" else rows
    first = F.min("time_ms").over(W.partitionBy(*K))
    g = rows.withColumn("__first", first).where("time_ms = __first").groupBy(*K).agg(F.max_by("score", "seq").alias("actual"), (F.count("*") > 1).alias("ambiguous"))
    return g


def rank_shape_profile(songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tier quantiles (tier, n, q10..q90) of scores against each song's best tier, and per song the regression of log share on log rank."""
    w = W.partitionBy("song_id")
    base = F.min(F.struct("tier", "score")).over(w)
    r = songs.where("score > 0").withColumn("__b", base).select("song_id", "tier", (F.col("score") / F.col("__b.score")).alias("norm"), (F.col("tier") / F.col("__b.tier")).alias("rel"))
    r = cut(r)
    tiers = exact_quantiles(r, ["tier"], "norm", {f"q{int(q * 100)}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9)})
    x, y = F.ln("rel"), F.ln("norm")
    fits = r.groupBy("song_id").agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")).where("n >= 2")
    return tiers, fits.withColumn("alpha", -F.col("slope"))


def activity_features(obs: DataFrame, contests: DataFrame, truth: DataFrame, panic_start: DataFrame | None = None) -> DataFrame:
    """(contest_id, tier, points, coverage, signed_rel[, panic_h]): how densely a series is observed, and how far its last row in the contest is from the truth.

    panic_start: (contest_id, tier, panic_start_h), which gives the length of the final phase.
    """
    rows = obs.join(contests.select("contest_id", "start_at", "end_at"), "contest_id").where("time_ms between start_at and end_at")
    g = rows.groupBy(*K).agg(F.count("*").alias("points"), F.max((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("hours"), F.max_by("score", F.struct("time_ms", "seq")).alias("last"))
    j = g.join(truth.select(*K, "actual"), K, "left")
    j = j if panic_start is None else j.join(panic_start, K, "left").withColumn("panic_h", F.col("hours") - F.coalesce("panic_start_h", F.lit(0.0)))
    coverage, rel = F.col("points") / F.greatest(F.col("hours"), F.lit(1.0)), (F.col("last") - F.col("actual")) / F.greatest(F.col("actual"), F.lit(1.0))
    return j.select(*K, "points", coverage.alias("coverage"), rel.alias("signed_rel"), *(["panic_h"] if panic_start is not None else []))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation, 1e-9 at least."""
    stats = df.agg(*[f for c in columns for f in (F.avg(c).alias(f"__m_{c}"), F.greatest(F.coalesce(F.stddev_pop(c), F.lit(0.0)), F.lit(1e-9)).alias(f"__s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def local_hour(time_ms: Column) -> Column:
    return F.hour(local_time(time_ms))
