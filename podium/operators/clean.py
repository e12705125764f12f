"""Projections, filters and gates: what may enter a series, and why the rest may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.schema import GRACE_MS, HOUR_MS, TIERS, TRAINING_TIERS, ZONE_MS, K

#: The names that score and time columns go by, in order of preference.
SCORE_NAMES, TIME_NAMES = ("value", "ep", "points", "score", "pt"), ("time", "timestamp", "time_ms")


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """`score` and `time_ms` from the first name of each list that exists; other columns stay. Values that do not cast are null."""
    score, time = next((c for c in SCORE_NAMES if c in df.columns), None), next((c for c in TIME_NAMES if c in df.columns), None)
    if score is None or time is None:
        raise ValueError("no score or time column")
    rest = [c for c in df.columns if c not in (score, time)]
    return df.select(*rest, F.col(time).cast("string").try_cast("long").alias("time_ms"), F.col(score).cast("string").try_cast("double").alias("score"))


def canonical_tier(tier: Column) -> Column:
    """Is it a canonical integer of the tier set? Leading zeros, fractions and other numbers are not."""
    return F.coalesce(tier.cast("string").rlike("^[1-9][0-9]*$") & tier.cast("string").isin(*map(str, TIERS)), F.lit(False))


def validate_tiers(df: DataFrame, column: str = "tier") -> tuple[DataFrame, DataFrame]:
    ok = canonical_tier(F.col(column))
    return df.where(ok), df.where(~ok)


def flag_observation_defects(df: DataFrame) -> DataFrame:
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (c < 0) | (F.abs(c.cast("double")) == float("inf"))
    return df.withColumns({"invalid_time": bad(F.col("time_ms")), "invalid_value": bad(F.col("score"))})


def usable(df: DataFrame) -> DataFrame:
    return flag_observation_defects(df).where("not invalid_time and not invalid_value").drop("invalid_time", "invalid_value")


def strict_contest_gate(obs: DataFrame, contests: DataFrame, training: tuple = TRAINING_TIERS, source: str | None = None, provenance: DataFrame | None = None, server: int | None = None) -> DataFrame:
    """(contest_id, accepted, reasons): the sorted defects of each contest; one is enough to reject all of it.

    Defects: end_not_after_start, bad_value, unknown_tier, duplicate_time, row_before_start, too_few_rows
    (under two in the window for a tier), missing_training_tier, wrong_source. provenance: (contest_id, reward_tiers
    array, last_appearance map[, server]) adds reward_tiers_differ, where the tiers are not the distinct last
    appearances or a contest has none, and wrong_server.
    """
    c = contests.select("contest_id", "start_at", "end_at")
    flagged = flag_observation_defects(obs)
    rows = flagged.join(c, "contest_id")
    tiers = rows.groupBy(*K).agg(
        F.max((F.col("invalid_time") | F.col("invalid_value")).cast("int")).alias("bad"),
        (F.count("*") - F.count_distinct("time_ms")).alias("dup"),
        F.max((F.col("time_ms") < F.col("start_at")).cast("int")).alias("early"),
        F.count_if(F.col("time_ms").between(F.col("start_at"), F.col("end_at"))).alias("inside"),
        F.max((F.col("source") != source).cast("int")).alias("foreign") if source else F.lit(0).alias("foreign"),
    )
    listed = tiers.groupBy("contest_id").agg(
        F.max("bad").alias("bad"), F.max(F.col("dup") > 0).alias("dup"), F.max("early").alias("early"), F.min("inside").alias("inside"), F.max("foreign").alias("foreign"),
        F.max(~canonical_tier(F.col("tier"))).alias("odd"), F.count_if(F.col("tier").isin(*training)).alias("have"),
    )
    say = lambda cond, word: F.when(cond, word)
    joined = c.join(listed, "contest_id", "left")
    more = []
    if provenance is not None:
        stated = F.sort_array(F.array_distinct("reward_tiers"))
        same = (F.size(stated) == F.size("reward_tiers")) & (stated == F.sort_array(F.array_distinct(F.map_values("last_appearance"))))
        foreign = F.coalesce(F.col("server") != server, F.lit(True)) if server is not None else F.lit(False)
        joined = joined.join(provenance.select("contest_id", (~F.coalesce(same, F.lit(False))).alias("differ"), foreign.alias("foreign_server")), "contest_id", "left")
        more = [say(F.coalesce("differ", F.lit(True)), "reward_tiers_differ"), say(F.coalesce("foreign_server", F.lit(server is not None)), "wrong_server")]
    reasons = F.array_sort(F.array_compact(F.array(
        say(F.col("end_at") <= F.col("start_at"), "end_not_after_start"), say(F.col("bad") == 1, "bad_value"), say(F.col("odd"), "unknown_tier"), say(F.col("dup"), "duplicate_time"),
        say(F.col("early") == 1, "row_before_start"), say(F.coalesce("inside", F.lit(0)) < 2, "too_few_rows"), say(F.coalesce("have", F.lit(0)) < len(training), "missing_training_tier"), say(F.col("foreign") == 1, "wrong_source"), *more)))
    return joined.select("contest_id", (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, ",").alias("reasons"))


def as_of_filter(obs: DataFrame, origins: DataFrame, response_at: str | None = None) -> DataFrame:
    """Rows visible at each contest's origin_ms: not later, and available by then; a null availability is not.

    response_at names a column with one availability for the whole tier instead: beyond the origin it empties
    the tier. Without any, all rows in time are visible and availability is `degraded`.
    """
    rows = obs.join(origins.select("contest_id", "origin_ms"), "contest_id").where("time_ms <= origin_ms")
    if response_at:
        return rows.where(F.col(response_at) <= F.col("origin_ms")).withColumn("availability", F.lit("response_level"))
    if "available_at" in obs.columns:
        return rows.where("available_at is not null and available_at <= origin_ms").withColumn("availability", F.lit("explicit_row_level"))
    return rows.withColumn("availability", F.lit("degraded"))


def window_class(obs: DataFrame, contests: DataFrame) -> DataFrame:
    """`window`: pre, in (both ends belong) or post; `in_grace`: post, but within 20 minutes."""
    rows = obs.join(contests.select("contest_id", "start_at", "end_at"), "contest_id")
    w = F.when(F.col("time_ms") < F.col("start_at"), "pre").when(F.col("time_ms") <= F.col("end_at"), "in").otherwise("post")
    return rows.withColumns({"window": w, "in_grace": (F.col("time_ms") > F.col("end_at")) & (F.col("time_ms") <= F.col("end_at") + GRACE_MS)})


def contest_meta(index: DataFrame, server: int) -> DataFrame:
    """(contest_id, contest_type, start_at, end_at, aggregate_at, usable) of one server; index has arrays of strings by server."""
    own = lambda c: F.get(F.col(c), F.lit(server)).try_cast("long")
    ends = F.coalesce(*[own(c) for c in ("endAt", "endAts") if c in index.columns])
    start = own("startAt")
    closing = F.coalesce(*[own(c) for c in ("aggregateAt", "aggregateEndAt", "aggregate_end_at") if c in index.columns], ends)
    kind = F.coalesce(F.col("eventType"), F.lit("unknown"))
    return index.select("contest_id", kind.alias("contest_type"), start.alias("start_at"), ends.alias("end_at"), closing.alias("aggregate_at"), (start.isNotNull() & ends.isNotNull()).alias("usable"))


def current_contest(contests: DataFrame, now_ms: int) -> DataFrame:
    """The running contest that started last; else the one whose start or end is nearest, on ties of the least id."""
    now = F.lit(now_ms)
    live = (F.col("start_at") <= now) & (now <= F.col("end_at"))
    gap = F.least(F.abs(F.col("start_at") - now), F.abs(F.col("end_at") - now))
    return contests.orderBy(F.desc(live), F.desc(F.when(live, F.col("start_at"))), gap, "contest_id").limit(1)


def ended_contests(contests: DataFrame, now_ms: int, types: list[str] | None = None, ids: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Contests that ended before now, newest ids first."""
    out = contests.where(F.coalesce("aggregate_at", "end_at") < now_ms)
    out = out.where(F.col("contest_type").isin(*types)) if types else out
    out = out.where(F.col("contest_id").between(*ids)) if ids else out
    out = out.orderBy(F.desc("contest_id"))
    return out.limit(limit) if limit else out


def is_live(contests: DataFrame, now_ms: int) -> DataFrame:
    last = F.greatest(F.when(F.col("aggregate_at") > 0, F.col("aggregate_at")), F.when(F.col("end_at") > 0, F.col("end_at")))
    return contests.withColumn("live", F.coalesce(F.lit(now_ms) <= last + GRACE_MS, F.lit(False)))


def corrected_start(obs: DataFrame, contests: DataFrame) -> DataFrame:
    """contests with the start moved to the hour of the first positive score, if that is later and within a day."""
    first = obs.where("score > 0").groupBy("contest_id").agg(F.min("time_ms").alias("first_ms"))
    hour = (F.col("first_ms") - F.pmod("first_ms", F.lit(HOUR_MS))).cast("long")
    moved = (F.col("first_ms") > F.col("start_at")) & (F.col("first_ms") < F.col("start_at") + 24 * HOUR_MS) & (hour > F.col("start_at"))
    return contests.join(first, "contest_id", "left").withColumn("start_at", F.when(moved, hour).otherwise(F.col("start_at"))).drop("first_ms")


def elapsed_and_phase(obs: DataFrame, contests: DataFrame) -> DataFrame:
    rows = obs.join(contests.select("contest_id", "start_at", "end_at"), "contest_id")
    rows = rows.withColumns({"hours": (F.col("time_ms") - F.col("start_at")) / float(HOUR_MS), "total_hours": (F.col("end_at") - F.col("start_at")) / float(HOUR_MS)})
    rows = rows.withColumn("progress", F.try_divide("hours", "total_hours"))
    return rows.withColumn("phase", F.when(F.col("progress") < 1 / 3, "early").when(F.col("progress") < 2 / 3, "middle").otherwise("late"))


def local_time(time_ms: Column) -> Column:
    return F.timestamp_millis((time_ms + ZONE_MS).cast("long"))


def parse_local_time(text: Column) -> Column:
    """Milliseconds of `yyyy-MM-dd HH:mm[:ss]` at UTC+8, whatever the session's zone; null for anything else."""
    fits = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2})?$")
    at = F.when(fits, F.try_to_timestamp(F.concat(F.rpad(F.trim(text), 19, ":00"), F.lit("+08:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    return F.unix_millis(at)


def day_type(time_ms: Column, is_workday: Column | None = None) -> Column:
    """weekday or weekend at UTC+8: Friday from 17 o'clock is weekend, Sunday from 23 weekday; then the calendar, if there is one, else Saturday and Sunday."""
    at = local_time(time_ms)
    day, hour = F.weekday(at), F.hour(at)
    usual = F.when(day >= 5, "weekend").otherwise("weekday")
    if is_workday is not None:
        usual = F.when(is_workday, "weekday").when(~is_workday, "weekend").otherwise(usual)
    return F.when((day == 4) & (hour >= 17), "weekend").when((day == 6) & (hour >= 23), "weekday").otherwise(usual)


def with_day_type(obs: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """day_type and hour (UTC+8). holidays: (date, is_workday), a calendar of some thousand days at most."""
    obs = obs.withColumn("hour", F.hour(local_time(F.col("time_ms"))))
    if holidays is None:
        return obs.withColumn("day_type", day_type(F.col("time_ms")))
    out = obs.withColumn("__date", F.to_date(local_time(F.col("time_ms")))).join(F.broadcast(holidays.select(F.col("date").alias("__date"), "is_workday")), "__date", "left")
    return out.withColumn("day_type", day_type(F.col("time_ms"), F.col("is_workday"))).drop("__date", "is_workday")


def profile_window(obs: DataFrame, after_start: int = 24, before_end: int = 48) -> DataFrame:
    """Rows from so many hours after the start to so many before the end, with a normalised speed of 0 to 1.2."""
    inside = (F.col("time_ms") >= F.col("start_at") + after_start * HOUR_MS) & (F.col("time_ms") <= F.col("end_at") - before_end * HOUR_MS)
    return obs.where(inside & F.col("norm_speed").between(0, 1.2))


def prefix_gate(prefixes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(contest_id, tier, origin_ms, valid, reason): the first reason why a prefix can't be forecast; nothing is repaired.

    prefixes: rows with contest_id, tier, origin_ms, time_ms, score, start_at, end_at. expected: the keys that
    should be there; those without a row have no_visible_row.
    """
    keys = [*K, "origin_ms"]
    w = W.partitionBy(*keys).orderBy("time_ms", "score")
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0)
    rows = prefixes.withColumns({"__before": F.lag("score").over(w), "__at": F.lag("time_ms").over(w)})
    g = rows.groupBy(*keys).agg(
        F.max(bad).alias("bad"), F.max(~F.col("time_ms").between(F.col("start_at"), F.col("end_at"))).alias("outside"), F.max(F.coalesce(F.col("__at") == F.col("time_ms"), F.lit(False))).alias("dup"),
        F.max(F.coalesce(F.col("score") < F.col("__before"), F.lit(False))).alias("falls"), F.max((F.col("time_ms") == F.col("start_at")) & (F.col("score") != 0)).alias("begun"),
        F.max_by("score", "time_ms").alias("last"), F.max((F.col("origin_ms") <= F.col("start_at")) | (F.col("origin_ms") >= F.col("end_at"))).alias("off"),
    )
    reason = F.when(F.col("off"), "origin_outside").when(F.col("bad"), "bad_score").when(F.col("outside"), "row_outside").when(F.col("dup"), "duplicate_time").when(F.col("falls"), "decreasing_score").when(F.col("begun"), "score_at_start").when(F.col("last") <= 0, "no_score")
    out = g.select(*keys, reason.alias("reason"))
    if expected is not None:
        out = out.withColumn("__seen", F.lit(True)).join(expected.select(*keys), keys, "right").withColumn("reason", F.when(F.col("__seen").isNull(), "no_visible_row").otherwise(F.col("reason"))).drop("__seen")
    return out.select(*keys, F.col("reason").isNull().alias("valid"), "reason")


def evaluation_gate(contests: DataFrame, obs: DataFrame, reward_tiers: DataFrame, as_of_ms: int, requested: DataFrame | None = None) -> DataFrame:
    """(contest_id, status): evaluable, or the first thing that prevents it. reward_tiers: (contest_id, tier).

    requested: (contest_id, tier), what was to be collected; other tiers than these in obs are inconsistent.
    """
    post = obs.join(contests.select("contest_id", "end_at"), "contest_id").groupBy(*K).agg(F.max(F.col("time_ms") > F.col("end_at")).alias("has_post"))
    per = reward_tiers.distinct().join(post, K, "left").groupBy("contest_id").agg(F.count("*").alias("tiers"), F.count_if(F.col("has_post").isNull()).alias("untracked"), F.count_if(~F.col("has_post")).alias("unfinished"))
    status = (
        F.when(F.coalesce("tiers", F.lit(0)) == 0, "not_applicable").when(F.col("end_at") >= as_of_ms, "not_completed")
        .when(F.col("untracked") > 0, "reward_tier_without_tracker").when(F.col("unfinished") > 0, "reward_tier_without_final")
    )
    rows = contests.join(per, "contest_id", "left")
    if requested is not None:
        want, have = (df.groupBy("contest_id").agg(F.sort_array(F.collect_set("tier")).alias(n)) for df, n in ((requested, "want"), (obs, "have")))
        rows = rows.join(want, "contest_id", "left").join(have, "contest_id", "left")
        status = status.when(~F.col("want").eqNullSafe(F.col("have")), "tiers_inconsistent")
    return rows.select("contest_id", status.otherwise("evaluable").alias("status"))
