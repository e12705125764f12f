"""Work along a series: speeds, repairs, resampling, as-of and interpolating joins, surfaces.

Plain windows hold a series in a task. Where a series may be too long for that, interval_speed, cummax_repair,
lookup_curve and interpolate_tier_asof take spread=True: the same rows by segments (segments.scan), at the price of
writing the input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.operators.segments import Run, scan
from podium.schema import DEFAULTS, GRACE_MS, HOUR_MS, TIERS, K

_UP = (W.unboundedPreceding, 0)


def _by_time(keys: list[str] = K, *more: str):
    return W.partitionBy(*keys).orderBy("time_ms", *more)


def _both_ways(*order: str):
    """An order and its reverse: what comes next is what came last the other way. A frame up to the end of a series would be read again for each row."""
    return list(order), [F.desc(c) for c in order]


def interval_speed(obs: DataFrame, policy: str = "zero", keys: list[str] = K, spread: bool = False) -> DataFrame:
    """`speed` in points a minute to the row before. zero: unusable and negative speeds are 0; drop: such rows go."""
    if spread:
        here = F.struct("score", "time_ms")
        obs = scan(obs, keys, ["time_ms", "seq"], {"__before": Run("before", here)})
        before = {c: F.col(f"__before.{c}") for c in ("score", "time_ms")}
    else:
        w = _by_time(keys, "seq")
        before = {c: F.lag(c).over(w) for c in ("score", "time_ms")}
    raw = F.try_divide(F.col("score") - before["score"], (F.col("time_ms") - before["time_ms"]) / 60000.0)
    raw = F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), None).otherwise(raw)
    if policy == "zero":
        return obs.withColumn("speed", F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.0)))).drop("__before")
    return obs.withColumn("speed", raw).where("speed >= 0").drop("__before")


def latest_revision(obs: DataFrame) -> DataFrame:
    """One row for each key and time: of the greatest available_at, then of the last arrival (seq)."""
    w = W.partitionBy(*K, "time_ms").orderBy(F.desc_nulls_last("available_at"), F.desc("seq"))
    return obs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def cummax_repair(obs: DataFrame, spread: bool = False) -> DataFrame:
    """`repaired`: the running maximum; `falls`: whether the raw score fell here."""
    if spread:
        rows = scan(obs, K, ["time_ms", "seq"], {"repaired": Run("max", F.col("score")), "__before": Run("before", F.col("score"))})
        return rows.withColumn("falls", F.coalesce(F.col("score") < F.col("__before"), F.lit(False))).drop("__before")
    w = _by_time(K, "seq")
    return obs.withColumns({"repaired": F.max("score").over(w.rowsBetween(*_UP)), "falls": F.coalesce(F.col("score") < F.lag("score").over(w), F.lit(False))})


def canonical_training_series(obs: DataFrame, contests: DataFrame) -> DataFrame:
    """(contest_id, tier, hours, score): the series that models are fitted on.

    Rows in the window; the first row after the end, if within 20 minutes, stands for the end and replaces a
    row there; the running maximum; (0, 0) in front where the first row is later. A score at hour 0 that is
    not 0 excludes the series. Rows of one time all stay, by seq where there is one: latest_revision leaves one.
    """
    tie = ["seq"] if "seq" in obs.columns else []
    rows = obs.join(contests.select("contest_id", "start_at", "end_at"), "contest_id").select(*K, "time_ms", *tie, "score", "start_at", "end_at")
    rows = rows.where(F.col("time_ms").between(F.col("start_at"), F.col("end_at") + GRACE_MS))
    # every window is one series': rows are dealt out and sorted once
    own, at = W.partitionBy(*K), F.struct("time_ms", *tie, "score")
    after = F.col("time_ms") > F.col("end_at")
    rows = rows.withColumn("closing", F.min(F.when(after, at)).over(own))
    rows = rows.where(F.when(after, at == F.col("closing")).otherwise(F.col("closing").isNull() | (F.col("time_ms") < F.col("end_at"))))
    rows = rows.withColumn("time_ms", F.least("time_ms", "end_at"))
    w = _by_time(K, *tie, "score")
    rows = rows.withColumns({"score": F.max("score").over(w.rowsBetween(*_UP)), "first": F.min(at).over(own), "place": F.row_number().over(w)}).where("first.time_ms > start_at or first.score = 0")
    here = F.struct(((F.col("time_ms") - F.col("start_at")) / float(HOUR_MS)).alias("hours"), "score")
    zero = F.struct(F.lit(0.0).alias("hours"), F.lit(0.0).alias("score"))
    begins = (F.col("place") == 1) & (F.col("time_ms") > F.col("start_at"))
    return rows.select(*K, F.explode(F.when(begins, F.array(zero, here)).otherwise(F.array(here))).alias("r")).select(*K, "r.hours", "r.score")


def training_diagnostics(obs: DataFrame, contests: DataFrame) -> DataFrame:
    """(contest_id, tier, mapped, delay_ms, disagreements, repaired_steps) of canonical_training_series."""
    rows = obs.join(contests.select("contest_id", "start_at", "end_at"), "contest_id")
    after = (F.col("time_ms") > F.col("end_at")) & (F.col("time_ms") <= F.col("end_at") + GRACE_MS)
    w = _by_time(K, "seq")
    rows = rows.withColumns({"__falls": F.coalesce(F.col("score") < F.lag("score").over(w), F.lit(False)) & (F.col("time_ms") <= F.col("end_at")), "__final": F.first(F.when(after, F.col("score")), True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    return rows.groupBy(*K).agg(
        F.max(after).alias("mapped"), F.min(F.when(after, F.col("time_ms") - F.col("end_at"))).alias("delay_ms"),
        F.count_if(after & (F.col("score") != F.col("__final"))).alias("disagreements"), F.count_if("__falls").alias("repaired_steps"),
    )


def history_series(obs: DataFrame, contests: DataFrame, keep_last: bool = True) -> DataFrame:
    """(contest_id, tier, hours, score): the last arrival of each time (else all its rows), the first row after the end at any delay put at the end, no repair, two rows or more."""
    c = contests.select("contest_id", "start_at", "end_at")
    rows = obs.join(c, "contest_id")
    if keep_last:
        w = W.partitionBy(*K, "time_ms").orderBy(F.desc("seq"))
        rows = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    post = rows.where("time_ms > end_at").groupBy(*K).agg(F.min_by("score", F.struct("time_ms", "seq")).alias("score")).join(c, "contest_id").select(*K, F.col("end_at").alias("time_ms"), "score", "start_at")
    inside = rows.where("time_ms between start_at and end_at").join(post.select(*K, F.lit(True).alias("__post")), K, "left").where("__post is null or time_ms < end_at")
    s = inside.select(*K, "time_ms", "score", "start_at").unionByName(post)
    n = F.count("*").over(W.partitionBy(*K))
    return s.withColumn("__n", n).where("__n >= 2").select(*K, ((F.col("time_ms") - F.col("start_at")) / float(HOUR_MS)).alias("hours"), "score")


def between(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation between two neighbours of which one may be missing (then the other holds)."""
    inner = y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0)
    return F.when(x0.isNull(), y1).when(x1.isNull(), y0).when(x1 == x0, y0).otherwise(inner)


def lookup_curve(points: DataFrame, curve: DataFrame, keys: list[str] = K, at: str = "hours", value: str = "score", out: str = "interpolated", spread: bool = False) -> DataFrame:
    """points with the curve's value at `at`: linear between its neighbours, the end values beyond them.

    Both sides are sorted by key once each way, so a task handles one key's rows in order and nothing is expanded. Of
    several values of a curve at one place the least ends what comes before it, and the greatest begins what follows.
    """
    rest = [c for c in points.columns if c not in (*keys, at)]
    a = points.select(*keys, F.col(at).alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__q"), F.struct(*rest).alias("__rest") if rest else F.struct(F.lit(0).alias("z")).alias("__rest"))
    b = curve.select(*keys, F.col(at).alias("__x"), F.col(value).cast("double").alias("__y"), F.lit(0).alias("__q"))
    both = a.unionByName(b, allowMissingColumns=True)
    known = F.when(F.col("__q") == 0, F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    if spread:
        both = scan(both, keys, ["__x", "__q", "__y"], {"__lo": Run("last", known), "__hi": Run("next", known)}).where("__q = 1")
    else:
        down, up = (W.partitionBy(*keys).orderBy(*o).rowsBetween(*_UP) for o in _both_ways("__x", "__q", "__y"))
        both = both.withColumns({"__lo": F.last(known, True).over(down), "__hi": F.last(known, True).over(up)}).where("__q = 1")
    v = between(F.col("__x"), F.col("__lo.x"), F.col("__lo.y"), F.col("__hi.x"), F.col("__hi.y"))
    return both.select(*keys, F.col("__x").alias(at), *[F.col(f"__rest.{c}").alias(c) for c in rest], v.alias(out))


def interpolate_tier_asof(obs: DataFrame, target: int, lower: int, upper: int, tolerance_ms: int = HOUR_MS, spread: bool = False) -> DataFrame:
    """(contest_id, time_ms, score): a missing tier between two published ones, by the logarithm of rank.

    Each row of the lower tier takes the nearest row of the upper one, within the tolerance, of equally near
    ones the earlier; rows without one go.
    """
    side = F.when(F.col("tier") == lower, 1).otherwise(0)
    rows = obs.where(F.col("tier").isin(lower, upper)).select("contest_id", "time_ms", "score", side.alias("q"))
    other = F.when(F.col("q") == 0, F.struct("time_ms", "score"))
    if spread:
        rows = scan(rows, ["contest_id"], ["time_ms", "q"], {"b": Run("last", other), "a": Run("next", other)}).where("q = 1")
    else:
        back, ahead = (F.last(other, True).over(W.partitionBy("contest_id").orderBy(*o).rowsBetween(*_UP)) for o in _both_ways("time_ms", "q"))
        rows = rows.withColumns({"b": back, "a": ahead}).where("q = 1")
    gap_b, gap_a = F.col("time_ms") - F.col("b.time_ms"), F.col("a.time_ms") - F.col("time_ms")
    near = F.when(F.col("b").isNull() | (gap_a < gap_b), F.col("a")).otherwise(F.col("b"))
    rows = rows.withColumn("n", near).where(F.abs(F.col("n.time_ms") - F.col("time_ms")) <= tolerance_ms)
    weight = F.ln(F.lit(target / lower)) / F.ln(F.lit(upper / lower))
    return rows.select("contest_id", "time_ms", F.greatest(F.lit(0.0), F.col("score") * (1 - weight) + F.col("n.score") * weight).alias("score"))


def adjacent_tiers(tiers: DataFrame) -> DataFrame:
    """(tier, lower, upper) among the published tiers of each contest."""
    w = W.partitionBy("contest_id").orderBy("tier")
    return tiers.select("contest_id", "tier").distinct().select("contest_id", "tier", F.lag("tier").over(w).alias("lower"), F.lead("tier").over(w).alias("upper"))


def daily_origins(contests: DataFrame, step_h: int = 24) -> DataFrame:
    """(contest_id, origin_h, origin_ms): every step_h hours, strictly before the end."""
    last = F.ceil((F.col("end_at") - F.col("start_at")) / float(HOUR_MS * step_h)).cast("int") - 1
    c = contests.where((F.col("end_at") - F.col("start_at")) > step_h * HOUR_MS)
    return c.select("contest_id", "start_at", F.explode(F.sequence(F.lit(1), last)).alias("k")).select("contest_id", (F.col("k") * step_h).alias("origin_h"), (F.col("start_at") + F.col("k") * step_h * HOUR_MS).alias("origin_ms"))


def prefix_join(obs: DataFrame, origins: DataFrame) -> DataFrame:
    """Every origin with the rows up to it. It repeats rows for each origin: for models that need them raw; sums take prefix_totals."""
    return obs.join(origins, "contest_id").where("time_ms <= origin_ms")


def last_rows(obs: DataFrame, origins: DataFrame, n: int = 2) -> DataFrame:
    """The n last rows between any two origins of a series: all that what looks at a prefix's last n rows needs, and few to repeat for each origin."""
    at = origins.groupBy("contest_id").agg(F.collect_set("origin_ms").alias("__at"))
    rows = obs.join(at, "contest_id").withColumn("__k", F.size(F.filter("__at", lambda o: o < F.col("time_ms")))).where(F.col("__k") < F.size("__at"))
    w = W.partitionBy(*K, "__k").orderBy(F.desc("time_ms"), F.desc("seq"))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__at", "__k", "__r")


def prefix_totals(obs: DataFrame, origins: DataFrame) -> DataFrame:
    """(contest_id, tier, origin_h, rows, last_score, max_score) of each prefix, without repeating rows: by the first origin that sees a row, then running.

    Origins may lie anywhere, and differ between contests; a contest has one origin_h for each origin_ms. Rows after
    the last origin are in no prefix; a prefix without rows is left out.
    """
    at = origins.groupBy("contest_id").agg(F.sort_array(F.collect_set(F.struct("origin_ms", "origin_h"))).alias("__at"))
    b = obs.join(at, "contest_id").withColumn("__o", F.get("__at", F.size(F.filter("__at", lambda o: o["origin_ms"] < F.col("time_ms"))))).where("__o is not null")
    b = b.groupBy(*K, F.col("__o.origin_ms").alias("origin_ms")).agg(F.count("*").alias("n"), F.max(F.struct("time_ms", "seq", "score")).alias("last"), F.max("score").alias("top"))
    grid = obs.select(*K).distinct().join(origins.select("contest_id", "origin_ms", "origin_h").distinct(), "contest_id")
    w = W.partitionBy(*K).orderBy("origin_ms").rowsBetween(*_UP)
    out = grid.join(b, [*K, "origin_ms"], "left").select(*K, "origin_h", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("rows"), F.max("last").over(w).getField("score").alias("last_score"), F.max("top").over(w).alias("max_score"))
    return out.where("rows > 0")


def attach_scale(obs: DataFrame, scales: DataFrame) -> DataFrame:
    """`scale` and `norm_speed`; contests without a positive scale go."""
    return obs.join(scales.where("scale > 0").select("contest_id", "scale"), "contest_id").withColumn("norm_speed", F.col("speed") / F.col("scale"))


def resample_surface(series: DataFrame, step_h: int = 1) -> DataFrame:
    """(contest_id, tier, hours, score): each contest's grid from its least to its greatest hour; linear inside a tier's rows, its last value after them, running maximum; nothing before its first."""
    span = series.groupBy("contest_id").agg(F.min("hours").alias("lo"), F.max("hours").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo") + step_h / 2 - 1e-9) / step_h).cast("int")
    own = series.groupBy(*K).agg(F.min("hours").alias("first"))
    grid = own.join(span, "contest_id").select(*K, "first", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("lo") + i * float(step_h))).alias("hours")).where("hours >= first").drop("first")
    out = lookup_curve(grid, series)
    w = W.partitionBy(*K).orderBy("hours").rowsBetween(*_UP)
    return out.select(*K, "hours", F.max("interpolated").over(w).alias("score"))


def pivot_surface(series: DataFrame, tiers: tuple = TIERS) -> DataFrame:
    """contest_id, hours, and a column t<tier> for each tier in canonical order; the last value on repeated times."""
    return series.groupBy("contest_id", "hours").pivot("tier", list(tiers)).agg(F.max_by("score", "seq") if "seq" in series.columns else F.max("score")).select("contest_id", "hours", *[F.col(str(t)).alias(f"t{t}") for t in tiers])


def unpivot_surface(wide: DataFrame, contests: DataFrame) -> DataFrame:
    """Long rows (contest_id, tier, hours, score) of a wide surface: finite values within the contest; tiers with a repeated time go."""
    cols = [c for c in wide.columns if c[0] == "t" and c[1:].isdigit()]
    long = wide.unpivot(["contest_id", "hours"], cols, "t", "score").withColumn("tier", F.substring("t", 2, 9).cast("int")).drop("t")
    long = long.join(contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("total")), "contest_id")
    long = long.where("score is not null and not isnan(score) and hours between 0 and total")
    n = F.count("*").over(W.partitionBy(*K, "hours"))
    return long.withColumn("__n", n).withColumn("__m", F.max("__n").over(W.partitionBy(*K))).where("__m = 1").select(*K, "hours", "score")


def baseline_forecasts(prefix: DataFrame, contests: DataFrame) -> DataFrame:
    """(contest_id, tier, origin_h, persistence, last_slope, average_speed): final scores that need no model; prefixes of two rows or more."""
    w = W.partitionBy(*K, "origin_h").orderBy(F.desc("time_ms"), F.desc("seq"))
    last = prefix.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(*K, "origin_h").agg(
        F.max(F.when(F.col("r") == 1, F.struct("time_ms", "score"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("time_ms", "score"))).alias("b"))
    x = last.where("b is not null").join(contests.select("contest_id", "start_at", "end_at"), "contest_id")
    left, gone = (F.col("end_at") - F.col("a.time_ms")) / float(HOUR_MS), (F.col("a.time_ms") - F.col("start_at")) / float(HOUR_MS)
    slope = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("a.score") - F.col("b.score"), (F.col("a.time_ms") - F.col("b.time_ms")) / float(HOUR_MS)), F.lit(0.0)))
    average = F.try_divide(F.col("a.score") * (F.col("end_at") - F.col("start_at")) / float(HOUR_MS), gone)
    return x.select(*K, "origin_h", F.col("a.score").alias("persistence"), (F.col("a.score") + slope * left).alias("last_slope"), average.alias("average_speed"))


def prefix_increments(series: DataFrame, origin_h: int, step_h: int = 6) -> DataFrame:
    """(contest_id, tier, knot, share): increments between knots 0, step, .. and the last visible hour, as shares of the score there."""
    seen = series.where(F.col("hours") <= origin_h)
    anchor = seen.groupBy(*K).agg(F.max("hours").alias("anchor_h"), F.max_by("score", F.struct("hours", "score")).alias("anchor")).where("anchor > 0 and anchor_h > 0")
    n = F.ceil(F.col("anchor_h") / step_h).cast("int") - 1
    knots = anchor.select(*K, "anchor", F.explode(F.concat(F.transform(F.sequence(F.lit(0), n), lambda i: (i * step_h).cast("double")), F.array("anchor_h"))).alias("hours"))
    at = lookup_curve(knots, seen)
    w = W.partitionBy(*K).orderBy("hours")
    out = at.withColumns({"before": F.lag("interpolated").over(w), "knot": F.row_number().over(w) - 2, "lo": F.lag("hours").over(w)})
    return out.where("before is not null").select(*K, "knot", "lo", F.col("hours").alias("hi"), ((F.col("interpolated") - F.col("before")) / F.col("anchor")).alias("share"))


def hourly_deltas(series: DataFrame, from_hour: float = 0.0) -> DataFrame:
    """(contest_id, tier, step, lo, delta): score change in each whole hour from the first row at or after from_hour."""
    own = series.where(F.col("hours") >= from_hour)
    span = own.groupBy(*K).agg(F.min("hours").alias("lo"), F.max("hours").alias("hi"))
    grid = span.where("hi - lo >= 1").select(*K, F.explode(F.sequence(F.lit(0), F.floor(F.col("hi") - F.col("lo") + 1e-9).cast("int"))).alias("i"), "lo").select(*K, "i", (F.col("lo") + F.col("i")).alias("hours"))
    w = W.partitionBy(*K).orderBy("i")
    at = lookup_curve(grid, own).withColumns({"before": F.lag("interpolated").over(w), "lo": F.lag("hours").over(w)})
    return at.where("before is not null").select(*K, (F.col("i") - 1).alias("step"), "lo", (F.col("interpolated") - F.col("before")).alias("delta"))


def refit_window(rows: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """Rows (with hours and skeleton_speed) from refit_start_hours on within the last refit_recent_hours, with `conf`, the span's share of refit_conf_norm_hours, at most refit_conf_max."""
    start, recent = config["refit_start_hours"], config["refit_recent_hours"]
    w = W.partitionBy(*K)
    kept = rows.where("skeleton_speed is not null and norm_speed is not null").withColumn("__max", F.max("hours").over(w)).where((F.col("hours") >= start) & (F.col("hours") >= F.col("__max") - recent)).drop("__max")
    span = F.max("hours").over(w) - F.min("hours").over(w)
    return kept.withColumn("conf", F.greatest(F.lit(0.0), F.least(span / config["refit_conf_norm_hours"], F.lit(config["refit_conf_max"]))))
