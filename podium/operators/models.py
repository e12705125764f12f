"""Forecast models: pace, cohorts and skeleton. Sums are made in Spark; what is left for numpy is a handful of unknowns a series."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from podium.functions import numeric
from podium.operators.aggregates import duration_weight
from podium.operators.clean import prefix_gate, strict_contest_gate, with_day_type
from podium.operators.curve_fit import PARAMS, _refit_bounds, fit_skeleton, refit_local, skeleton_shape  # noqa: F401
from podium.operators.evaluate import coverage_gate
from podium.operators.series import canonical_training_series, hourly_deltas, lookup_curve
from podium.schema import DEFAULTS, GRACE_MS, HOUR_MS, ZONE_MS, K
from podium.session import cut

AMPLITUDE, PEAK, EPSILON, POWER = 0.3, 21.0, 0.08, 1.6
#: Templates (about 200 bytes each) that meet the prefixes at once, by broadcast.
TEMPLATES = 20_000


@F.pandas_udf(DoubleType())
def _urgency(t: pd.Series, total: pd.Series, start_local: pd.Series) -> pd.Series:
    return pd.Series(numeric.urgency_integral(t, total, start_local))


def _start_local(start_at: Column) -> Column:
    return F.pmod((start_at + ZONE_MS) / float(HOUR_MS), F.lit(24.0))


def _available(t: Column, h0: Column) -> Column:
    """Integrated availability from 0 to t; its floor is never reached."""
    c = 2 * math.pi / 24
    return t + AMPLITUDE / c * (F.sin((t + h0 - PEAK) * c) - F.sin((h0 - PEAK) * c))


def reward_pressure(reward_tiers: DataFrame, tiers: DataFrame) -> DataFrame:
    """(contest_id, tier, pressure): how much a rank is worth, from its place and the share of reward ranks at or beyond it."""
    j = tiers.select(*K).distinct().join(reward_tiers.select("contest_id", F.col("tier").alias("reward")).distinct(), "contest_id", "left")
    share = F.coalesce(F.avg(F.when(F.col("reward").isNotNull(), (F.col("reward") >= F.col("tier")).cast("double"))), F.lit(0.0))
    g = j.groupBy(*K).agg(share.alias("share"))
    rank = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(F.lit(1e5) / F.col("tier")) / math.log(1e5)))
    return g.select(*K, (1 - (1 - (0.15 + 0.85 * rank)) * (1 - F.col("share"))).alias("pressure"))


def pace_components(points: DataFrame, contests: DataFrame, pressure: DataFrame) -> DataFrame:
    """points (contest_id, tier, hours, ..) with cumulative c1..c3 and instantaneous a1..a3 components.

    The one integral without a closed form is taken once for each distinct (contest, hour).
    """
    c = contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("__T"), _start_local(F.col("start_at")).alias("__h0"))
    at = points.select("contest_id", "hours").distinct().join(c, "contest_id").withColumn("__g", _urgency("hours", "__T", "__h0"))
    p = points.join(at, ["contest_id", "hours"]).join(pressure, K)
    t, h0, total = F.col("hours"), F.col("__h0"), F.col("__T")
    h, ht = _available(t, h0), _available(total, h0)
    a = F.greatest(1 + AMPLITUDE * F.cos((t + h0 - PEAK) * (2 * math.pi / 24)), F.lit(0.05))
    u = F.pow(EPSILON / (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - t) / total)) + EPSILON), POWER)
    out = p.withColumns({"c1": h, "c2": h - h * h / (2 * ht), "c3": F.col("pressure") * F.col("__g"), "a1": a, "a2": a * (1 - h / ht), "a3": a * F.col("pressure") * u})
    return out.drop("__T", "__h0", "__g", "pressure")


def fit_pace_weights(series: DataFrame, contests: DataFrame, pressure: DataFrame) -> DataFrame:
    """(contest_id, w1, w2, w3, loss, n_series): weights of the pace components; 13 sums for each series reach the helper."""
    w = W.partitionBy(*K).orderBy("hours", "score")
    x = pace_components(series, contests, pressure)
    dt = F.col("hours") - F.lag("hours").over(w)
    d = x.select(*K, dt.alias("dt"), *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in ("c1", "c2", "c3")], (F.col("score") - F.lag("score").over(w)).alias("y")).where("dt > 0")
    d = d.select(*K, "dt", *[(F.col(c) / F.col("dt")).alias(c) for c in ("c1", "c2", "c3", "y")])
    names = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = [F.sum(F.col("dt") * F.col(f"c{i + 1}") * F.col(f"c{j + 1}")).alias(f"g{i}{j}") for i, j in names] + [F.sum(F.col("dt") * F.col(f"c{i + 1}") * F.col("y")).alias(f"b{i}") for i in range(3)]
    k = d.groupBy(*K).agg(*sums, F.sum(F.col("dt") * F.col("y") * F.col("y")).alias("e")).where("e > 0")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tier")
        g = np.zeros((len(pdf), 3, 3))
        for i, j in names:
            g[:, i, j] = g[:, j, i] = pdf[f"g{i}{j}"]
        b, e = pdf[["b0", "b1", "b2"]].to_numpy(), pdf["e"].to_numpy()
        best = numeric.simplex_minimum(lambda x: numeric.profiled_loss(x, g, b, e))
        return pd.DataFrame({"contest_id": pdf["contest_id"][:1], "w1": best[0], "w2": best[1], "w3": best[2], "loss": numeric.profiled_loss(best[None], g, b, e)[0], "n_series": len(pdf)})

    return k.groupBy("contest_id").applyInPandas(solve, "contest_id long, w1 double, w2 double, w3 double, loss double, n_series long")


def event_equal_mean(fits: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean of simplex vectors, one of each contest, brought back to sum 1."""
    g = fits.groupBy(*(keys or [])).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n"))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return g.select(*(keys or []), *[(F.col(c) / total).alias(c) for c in columns], "n")


def causal_prior(targets: DataFrame, fits: DataFrame, columns: list[str], train_max: int | None = None) -> DataFrame:
    """For each target contest the mean of the fits of contests that ended before it began. fits: contest_id, end_at and columns; a row a contest."""
    f = fits.select(F.col("contest_id").alias("__f"), F.col("end_at").alias("__end"), *columns)
    f = f.where(F.col("__f") <= train_max) if train_max is not None else f
    # running sums in the order of time: a fit counts from its end on, a target takes what has ended before its start
    ends = f.select(F.col("__end").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("contest_id"), *columns)
    starts = targets.select(F.col("start_at").alias("at"), F.lit(0).alias("side"), "contest_id", *[F.lit(None).cast("double").alias(c) for c in columns])
    both = ends.unionByName(starts)
    w = W.orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)  # a row a contest, twice
    run = both.select("side", "contest_id", *[F.avg(c).over(w).alias(c) for c in columns], F.count(columns[0]).over(w).alias("n")).where("side = 0 and n > 0")
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return run.select("contest_id", *[(F.col(c) / total).alias(c) for c in columns], "n")


def pace_paths(prefixes: DataFrame, prior: DataFrame, contests: DataFrame, pressure: DataFrame, expected: DataFrame | None = None, step_h: int = 1) -> tuple[DataFrame, DataFrame]:
    """(paths, rejects) of prefixes as they were seen: (contest_id, tier, origin_ms, anchor_h, anchor, hours, score, speed) from the origin to the end, and (contest_id, tier, origin_ms, reason).

    prefixes: rows (contest_id, tier, origin_ms, time_ms, score), none repaired: prefix_gate says which cannot be forecast,
    and why; expected: keys that should be there. Hours are the origin, every step_h after it, and the end; the score is
    S(a) C(t) / C(a) from the last visible row, the speed, in points an hour, its derivative.
    """
    at = contests.select("contest_id", "start_at", "end_at")
    rows = cut(prefixes.select(*K, "origin_ms", "time_ms", "score").join(at, "contest_id"))
    gate = cut(prefix_gate(rows, expected))
    keys = [*K, "origin_ms"]
    last = rows.join(gate.where("valid").select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max(F.struct("time_ms", "score")).alias("a"))
    hour = lambda c: (F.col(c) - F.col("start_at")) / float(HOUR_MS)
    last = last.join(at, "contest_id").select(*keys, hour("a.time_ms").alias("anchor_h"), F.col("a.score").alias("anchor"), hour("origin_ms").alias("origin_h"), hour("end_at").alias("total_h"))
    steps = F.sequence(F.lit(0), F.ceil((F.col("total_h") - F.col("origin_h")) / step_h).cast("int"))
    path = last.withColumn("hours", F.explode(F.transform(steps, lambda k: F.least(F.col("origin_h") + k * float(step_h), F.col("total_h")))))
    places = path.select(*K, "hours").unionByName(last.select(*K, F.col("anchor_h").alias("hours"))).distinct()
    comp = pace_components(places, contests, pressure)
    comp = comp.join(prior.select("contest_id", "w1", "w2", "w3"), "contest_id") if "contest_id" in prior.columns else comp.crossJoin(F.broadcast(prior.select("w1", "w2", "w3")))  # one row
    mixed = lambda x: sum((F.col(f"w{i}") * F.col(f"{x}{i}") for i in (2, 3)), F.col("w1") * F.col(f"{x}1"))
    comp = cut(comp.select(*K, "hours", mixed("c").alias("c"), mixed("a").alias("a")))
    j = path.join(comp, [*K, "hours"]).join(comp.select(*K, F.col("hours").alias("anchor_h"), F.col("c").alias("c_a")), [*K, "anchor_h"])
    amplitude = F.try_divide("anchor", "c_a")
    return j.select(*keys, "anchor_h", "anchor", "hours", (amplitude * F.col("c")).alias("score"), (amplitude * F.col("a")).alias("speed")), gate.where("not valid").select(*keys, "reason")


def forecast_pace(prefix: DataFrame, prior: DataFrame, contests: DataFrame, pressure: DataFrame) -> DataFrame:
    """(contest_id, tier, origin_h, anchor_h, anchor, final, speed_now): S(T) = S(a) C(T) / C(a) from the last visible row.

    prefix: valid prefixes (contest_id, tier, origin_h, hours, score); prior: w1..w3 (one row, or one a contest).
    """
    a = prefix.groupBy(*K, "origin_h").agg(F.max("hours").alias("anchor_h"), F.max_by("score", F.struct("hours", "score")).alias("anchor")).where("anchor > 0 and anchor_h > 0")
    total = contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("total_h"))
    a = a.join(total, "contest_id")
    places = a.select(*K, F.explode(F.array("anchor_h", "total_h")).alias("hours")).distinct()
    comp = pace_components(places, contests, pressure)
    comp = comp.join(prior.select("contest_id", "w1", "w2", "w3"), "contest_id") if "contest_id" in prior.columns else comp.crossJoin(F.broadcast(prior.select("w1", "w2", "w3")))  # one row
    mixed = lambda x: sum((F.col(f"w{i}") * F.col(f"{x}{i}") for i in (2, 3)), F.col("w1") * F.col(f"{x}1"))
    comp = comp.select(*K, "hours", mixed("c").alias("C"), mixed("a").alias("A"))
    at = lambda h, c, s: comp.select(*K, F.col("hours").alias(h), F.col("C").alias(c), F.col("A").alias(s))
    j = a.join(at("anchor_h", "c_a", "s_a"), [*K, "anchor_h"]).join(at("total_h", "c_t", "s_t"), [*K, "total_h"])
    return j.select(*K, "origin_h", "anchor_h", "anchor", (F.col("anchor") * F.col("c_t") / F.col("c_a")).alias("final"), (F.col("anchor") / F.col("c_a") * F.col("s_a")).alias("speed_now"))


def mass_basis(points: DataFrame, contests: DataFrame) -> DataFrame:
    """points with `basis`: the six cohorts' cumulative shares of effort, all 0 at the start and 1 at the end."""
    c = contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("__T"), _start_local(F.col("start_at")).alias("__h0"))
    p = points.join(c, "contest_id").withColumn("__x", _available(F.col("hours"), F.col("__h0")) / _available(F.col("__T"), F.col("__h0")))
    x = F.col("__x")
    out = [x] + [(1 - F.exp(-x / tau)) / (1 - math.exp(-1 / tau)) for tau in (0.05, 0.20)] + [(F.exp((x - 1) / tau) - math.exp(-1 / tau)) / (1 - math.exp(-1 / tau)) for tau in (0.03, 0.10, 0.30)]
    return p.withColumn("basis", F.array(*out)).drop("__T", "__h0", "__x")


def mass_rate(points: DataFrame, contests: DataFrame) -> DataFrame:
    """points with `rate`: how fast each entry of mass_basis grows, an hour."""
    c = contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("__T"), _start_local(F.col("start_at")).alias("__h0"))
    whole = _available(F.col("__T"), F.col("__h0"))
    p = points.join(c, "contest_id").withColumns({"__x": _available(F.col("hours"), F.col("__h0")) / whole, "__v": (1 + AMPLITUDE * F.cos((F.col("hours") + F.col("__h0") - PEAK) * (2 * math.pi / 24))) / whole})
    grow = lambda x, tau: F.exp(x / tau) / tau / (1 - math.exp(-1 / tau))
    out = [F.lit(1.0)] + [grow(-F.col("__x"), tau) for tau in (0.05, 0.20)] + [grow(F.col("__x") - 1, tau) for tau in (0.03, 0.10, 0.30)]
    return p.withColumn("rate", F.array(*[F.col("__v") * x for x in out])).drop("__T", "__h0", "__x", "__v")


def pace_basis(points: DataFrame, contests: DataFrame, pressure: DataFrame) -> DataFrame:
    """points with `basis`: the three pace components, each divided by its value at the end."""
    ends = points.select(*K).distinct().join(contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("hours")), "contest_id")
    last = pace_components(ends, contests, pressure).select(*K, *[F.col(f"c{i}").alias(f"__c{i}") for i in (1, 2, 3)])
    return pace_components(points, contests, pressure).join(last, K).withColumn("basis", F.array(*[F.col(f"c{i}") / F.col(f"__c{i}") for i in (1, 2, 3)])).drop(*[f"{a}{i}" for a in ("c", "a", "__c") for i in (1, 2, 3)])


def fit_cohort_mass(series: DataFrame, contests: DataFrame, dims: int = 6) -> DataFrame:
    """(contest_id, tier, mass, rmse): masses on the simplex, least squares weighted by time. series: with basis, and a row at the end."""
    w = W.partitionBy(*K).orderBy("hours", "score")
    total = contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("__T"))
    s = series.join(total, "contest_id").withColumns({"__prev": F.lag("hours").over(w), "__next": F.lead("hours").over(w), "__last": F.max(F.struct("hours", "score")).over(W.partitionBy(*K))})
    s = s.where("abs(__last.hours - __T) < 1e-8 and __last.score > 0")
    weight = (F.coalesce(F.col("__next"), F.col("hours")) - F.coalesce(F.col("__prev"), F.col("hours"))) / 2 / F.col("__T")
    s = s.select(*K, weight.alias("q"), (F.col("score") / F.col("__last.score")).alias("y"), *[F.col("basis")[i].alias(f"x{i}") for i in range(dims)])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    k = s.groupBy(*K).agg(F.array(*[F.sum(F.col("q") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("g"), F.array(*[F.sum(F.col("q") * F.col(f"x{i}") * F.col("y")) for i in range(dims)]).alias("b"), F.sum(F.col("q") * F.col("y") * F.col("y")).alias("yy"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for g, b, yy in zip(pdf["g"], pdf["b"], pdf["yy"], strict=True):
                gram = np.zeros((dims, dims))
                for (i, j), v in zip(pairs, g, strict=True):
                    gram[i, j] = gram[j, i] = v
                b = np.array(b)
                m = numeric.simplex_least_squares(gram, b)
                rows.append((m.tolist(), math.sqrt(max(0.0, m @ gram @ m - 2 * m @ b + yy))))
            yield pd.DataFrame({"contest_id": pdf["contest_id"], "tier": pdf["tier"], "mass": [m for m, _ in rows], "rmse": [r for _, r in rows]})

    return k.mapInPandas(solve, "contest_id long, tier int, mass array<double>, rmse double")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def forecast_cohort(knots: DataFrame, templates: DataFrame, contests: DataFrame, strength: float = 16.0, same_type: bool = False, transfer: bool = False, bandwidth: float = math.log(2), dims: int = 0, configs: list[dict] | None = None) -> DataFrame:
    """(contest_id, tier, origin_h, anchor, final, templates, effective): posterior mean over earlier contests' cohort masses.

    With dims, the number of masses, also `shape`: their posterior mean, each over its curve at the anchor, so that the
    score at any hour is anchor times the basis there times shape.

    configs: settings (config_id, strength, same_type, transfer) to try in place of the three arguments; rows then have
    config_id. They are one column of the plan, which is the same however many there are: a prefix meets a template once,
    and the divergence is found once with transfer and once without.

    knots: rows of a prefix (contest_id, tier, origin_h, i, share, basis, anchor_h, anchor, end_basis, start_at,
    contest_type, pressure), i from 0 (share 0) up to the anchor; templates: (contest_id, end_at, contest_type,
    tier, mass, pressure). Only templates that ended before the contest began count.
    """
    key = [*K, "origin_h"]
    p = knots.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("i", "share", "basis"))).alias("k"), F.max("anchor_h").alias("anchor_h"), F.max("anchor").alias("anchor"), F.max_by("end_basis", "i").alias("end_basis"),
        F.max("start_at").alias("start_at"), F.max("contest_type").alias("contest_type"), F.max("pressure").alias("pressure"),
    )
    t = templates.select(F.col("contest_id").alias("t_id"), F.col("end_at").alias("t_end"), F.lower("contest_type").alias("t_type"), F.col("tier").alias("t_tier"), "mass", F.col("pressure").alias("t_pressure"))
    # every prefix meets every earlier template: templates of a block are broadcast, more blocks are dealt out
    n = templates.count()
    blocks = max(1, -(-n // TEMPLATES))
    t = t.withColumn("block", F.pmod(F.xxhash64("t_id", "t_tier"), F.lit(blocks)))
    p = p.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if same_type:
        p, on = p.withColumn("t_type", F.lower("contest_type")), ["block", "t_type"]
    else:
        on = ["block"]
    j = p.join(F.broadcast(t) if blocks == 1 else t, on).where("t_end < start_at")
    mass = F.col("mass")
    if configs is not None:
        groups = [{"transfer": x, "runs": [{"config_id": c["config_id"], "strength": float(c["strength"]), "same_type": bool(c.get("same_type", False))} for c in configs if bool(c.get("transfer", False)) == x]} for x in (False, True)]
        kind = "array<struct<transfer: boolean, runs: array<struct<config_id: string, strength: double, same_type: boolean>>>>"
        j = j.withColumn("cfg", F.explode(F.from_json(F.lit(json.dumps([g for g in groups if g["runs"]])), kind)))
    if transfer or configs is not None:
        size = F.size("mass")
        first = F.when(size == 3, 2).otherwise(3)
        moved = F.transform(mass, lambda m, i: F.when(i >= first, m * F.col("pressure") / F.col("t_pressure")).otherwise(m))
        j = j.withColumn("moved", moved)
        moved = F.transform("moved", lambda m: m / F.aggregate("moved", F.lit(0.0), lambda s, v: s + v))
        j = j.withColumn("mass", moved if configs is None else F.when(F.col("cfg.transfer"), moved).otherwise(mass))
        mass = F.col("mass")
    j = j.withColumn("curve", F.transform("k", lambda s: _dot(s["basis"], mass)))
    j = j.withColumns({"f_anchor": F.element_at("curve", -1), "f_end": _dot(F.col("end_basis"), mass)}).where("f_anchor > 0")
    bins = F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.struct(F.col("k")[i]["share"].alias("p"), ((F.col("curve")[i] - F.col("curve")[i - 1]) / F.col("f_anchor")).alias("q")))
    kl = F.aggregate(bins, F.lit(0.0), lambda s, b: s + F.when(b["p"] > 0, b["p"] * (F.ln(b["p"]) - F.ln(F.greatest(b["q"], F.lit(1e-300))))).otherwise(0.0))
    prior = -0.5 * F.pow(F.ln(F.col("t_tier") / F.col("tier")) / bandwidth, 2)
    if configs is not None:
        j = j.withColumn("kl", kl).withColumn("run", F.explode("cfg.runs")).where(~F.col("run.same_type") | (F.col("t_type") == F.lower("contest_type")))
        j, key, kl, strength = j.withColumn("config_id", F.col("run.config_id")), [*key, "config_id"], F.col("kl"), F.col("run.strength")
    # the arrays end here; a row has the logarithms of the prior (u) and of the posterior (v), and the growth
    j = j.select(*key, "t_id", "anchor", prior.alias("u"), (prior - strength * F.col("anchor_h") / 24 * kl).alias("v"), (F.col("f_end") / F.col("f_anchor")).alias("g"), *([F.transform(mass, lambda m: m / F.col("f_anchor")).alias("h")] if dims else []))
    one = j.groupBy(*key, "t_id").agg(F.max("anchor").alias("anchor"), F.collect_list(F.struct("u", "v", "g", *["h"] * bool(dims))).alias("x"))  # a contest's tiers, 24 at most
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda s, r: s + f(r))
    one = one.withColumn("m", F.array_max(F.transform("x", lambda r: r["v"])))
    one = one.select(
        *key, "anchor", (F.col("m") - F.ln(total(lambda r: F.exp(r["u"])))).alias("m"), total(lambda r: F.exp(r["v"] - F.col("m"))).alias("w"),
        total(lambda r: F.exp(r["v"] - F.col("m")) * r["g"]).alias("wg"), total(lambda r: F.exp(2 * (r["v"] - F.col("m")))).alias("ww"), F.size("x").cast("long").alias("n"),
        *[total(lambda r, i=i: F.exp(r["v"] - F.col("m")) * r["h"][i]).alias(f"wh{i}") for i in range(dims)],
    )
    # contests weigh alike, so their common factor goes; the greatest logarithm keeps the sums from vanishing
    one = one.withColumn("up", F.exp(F.col("m") - F.max("m").over(W.partitionBy(*key))))
    g = one.groupBy(*key).agg(F.max("anchor").alias("anchor"), F.sum(F.col("up") * F.col("w")).alias("w"), F.sum(F.col("up") * F.col("wg")).alias("wg"), F.sum(F.col("up") * F.col("up") * F.col("ww")).alias("ww"), F.sum("n").alias("templates"), *[F.sum(F.col("up") * F.col(f"wh{i}")).alias(f"wh{i}") for i in range(dims)])
    shape = [F.array(*[F.col(f"wh{i}") / F.col("w") for i in range(dims)]).alias("shape")] if dims else []
    return g.select(*key, "anchor", (F.col("anchor") * F.col("wg") / F.col("w")).alias("final"), "templates", (F.col("w") * F.col("w") / F.col("ww")).alias("effective"), *shape)


def cohort_paths(prefixes: DataFrame, templates: DataFrame, contests: DataFrame, pressure: DataFrame, expected: DataFrame | None = None, step_h: int = 1, knot_h: int = 6, **options) -> tuple[DataFrame, DataFrame]:
    """(paths, rejects) as pace_paths has them, by cohorts: (contest_id, tier, origin_ms, anchor_h, anchor, hours, score, speed, effective), and (contest_id, tier, origin_ms, reason).

    prefixes and expected: as pace_paths takes them, none repaired. templates and options: as forecast_cohort takes them; a
    sound prefix that no earlier contest explains has the reason no_history. The posterior is found once a prefix; hours
    cost a product of six numbers each. pressure: (contest_id, tier, pressure).
    """
    keys = [*K, "origin_ms"]
    at = contests.select("contest_id", "start_at", "end_at", "contest_type")
    rows = cut(prefixes.select(*keys, "time_ms", "score").join(at, "contest_id"))
    gate = cut(prefix_gate(rows, expected))
    hour = lambda c: (F.col(c) - F.col("start_at")) / float(HOUR_MS)
    sound = rows.join(gate.where("valid").select(*keys), keys, "left_semi").withColumn("hours", hour("time_ms"))
    last = sound.groupBy(*keys).agg(F.max("hours").alias("anchor_h"), F.max_by("score", F.struct("hours", "score")).alias("anchor"), *[F.max(c).alias(c) for c in ("start_at", "end_at", "contest_type")]).where("anchor_h > 0")
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.col("anchor_h") / knot_h).cast("int") - 1), lambda i: (i * knot_h).cast("double"))
    knots = lookup_curve(last.select("*", F.explode(F.concat(steps, F.array("anchor_h"))).alias("hours")), sound, keys)
    w = W.partitionBy(*keys).orderBy("hours")
    share = F.coalesce((F.col("interpolated") - F.lag("interpolated").over(w)) / F.col("anchor"), F.lit(0.0))
    knots = knots.withColumns({"i": F.row_number().over(w) - 1, "share": share, "end_basis": F.array(*[F.lit(1.0)] * 6)})
    knots = cut(mass_basis(knots, contests).join(pressure, K).withColumnRenamed("origin_ms", "origin_h"))
    about = knots.where("i = 0").select(*K, F.col("origin_h").alias("origin_ms"), "anchor_h", "start_at", "end_at")
    found = cut(forecast_cohort(knots, templates, contests, dims=6, **options).withColumnRenamed("origin_h", "origin_ms").select(*keys, "anchor", "effective", "shape").join(about, keys))
    first, end = hour("origin_ms"), hour("end_at")
    grid = F.transform(F.sequence(F.lit(0), F.ceil((end - first) / step_h).cast("int")), lambda k: F.least(first + k * float(step_h), end))
    path = mass_rate(mass_basis(found.withColumn("hours", F.explode(grid)).drop("start_at", "end_at"), contests), contests)
    path = path.select(*keys, "anchor_h", "anchor", "hours", (F.col("anchor") * _dot(F.col("basis"), F.col("shape"))).alias("score"), (F.col("anchor") * _dot(F.col("rate"), F.col("shape"))).alias("speed"), "effective")
    alone = gate.where("valid").select(*keys).join(found, keys, "left_anti").withColumn("reason", F.lit("no_history"))
    return path, gate.where("not valid").select(*keys, "reason").unionByName(alone)


def align_duration(params: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """params (.., base .. panic, target_h, history_h, ratio): a and b brought to the target's duration, then all to its strength."""
    w = duration_weight(F.col("target_h"), F.col("history_h"), config["duration_param_align_max_weight"], config)
    r = F.exp(F.ln(F.col("target_h") / F.col("history_h")) * w)
    q = F.col("ratio")
    return params.withColumns({"base": F.col("base") * q, "a": F.col("a") / r * q, "b": F.col("b") / (r * r) * q, "b_end": F.col("b_end") * F.pow(q, 1.1)})


def apply_season(grid: DataFrame, factors: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """grid (contest_id, tier, hours, start_at, total_h, panic, skeleton) with `speed_norm`: times the hour's factor, more so towards the end."""
    g = with_day_type(grid.withColumn("time_ms", (F.col("start_at") + F.col("hours") * HOUR_MS).cast("long"))).join(F.broadcast(factors), ["day_type", "hour"], "left")
    left = F.col("total_h") - F.col("hours")
    prog = F.when((F.col("panic") > 0) & (left < F.col("panic")), 1 - F.greatest(F.lit(0.0), left) / F.col("panic")).otherwise(0.0)
    eased = F.when(prog > 0, F.pow(prog, config["panic_ease_power"])).otherwise(0.0)
    return g.withColumn("speed_norm", F.col("skeleton") * F.coalesce("factor", F.lit(1.0)) * (1 + (config["panic_scaler"] - 1) * eased)).drop("day_type", "hour", "factor", "time_ms")


def kalman_strength(steps: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(contest_id, tier, scale, trend): a level and its drift folded over hourly steps (step, delta, model), in the JVM."""
    c = config
    lit = lambda **kw: F.struct(*[F.lit(float(v)).alias(k) for k, v in kw.items()])
    rows = steps.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("step", "delta", "model"))).alias("s"))

    def fold(x, o):
        level = x["s"] + x["t"]
        p11, p12, p22 = x["a"] + 2 * x["b"] + x["d"] + c["kf_Q_scale"], x["b"] + x["d"], x["d"] + c["kf_Q_trend"]
        raw = F.try_divide(o["delta"], o["model"])
        z = F.greatest(F.lit(c["kf_z_clip_min"]), F.least(F.lit(c["kf_z_clip_max"]), raw))
        r = c["kf_base_R"] + 0.01 * c["kf_adaptive_R_numerator"] / (o["model"] + 1.0) + F.when(F.abs(raw - z) > 0.1, c["kf_clip_penalty"]).otherwise(0.0)
        k1, k2 = p11 / (p11 + r), p12 / (p11 + r)
        y = z - level
        new = F.struct((level + k1 * y).alias("s"), (x["t"] + k2 * y).alias("t"), ((1 - k1) * p11).alias("a"), ((1 - k1) * p12).alias("b"), (p22 - k2 * p12).alias("d"))
        old = F.struct(level.alias("s"), x["t"].alias("t"), p11.alias("a"), p12.alias("b"), p22.alias("d"))
        return F.when(o["model"] > c["kf_min_delta_model"], new).otherwise(old)

    state = F.aggregate("s", lit(s=1, t=0, a=c["kf_init_P_scale"], b=0, d=c["kf_init_P_trend"]), fold)
    return rows.withColumn("x", state).select(*K, F.col("x.s").alias("scale"), F.col("x.t").alias("trend"))


def future_scale_curve(grid: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """grid (hours, scale, trend, now_h, panic, total_h) with `curve`: the clipped level, its damped drift after now, pulled to 1 in the final rise."""
    c = config
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    lam = math.log(2) / max(c["kf_trend_half_life_hours"], 1e-6)
    ahead = F.greatest(F.lit(0.0), F.col("hours") - F.col("now_h"))
    s = F.greatest(F.lit(0.1), clip(F.col("scale"), c["kf_scale_clip_min"], c["kf_scale_clip_max"]) + clip(F.col("trend"), c["kf_trend_clip_min"], c["kf_trend_clip_max"]) * (1 - F.exp(-lam * ahead)) / lam)
    prog = F.when((F.col("panic") > 0) & (F.col("hours") > F.col("total_h") - F.col("panic")), clip((F.col("hours") - F.col("total_h") + F.col("panic")) / F.col("panic"), 0.0, 1.0)).otherwise(0.0)
    return grid.withColumn("curve", s * (1 - prog * prog) + prog * prog)


def compress_speed(v: Column, config: dict = DEFAULTS) -> Column:
    """High speeds are damped in two stages and capped."""
    t1, t2, cap = config["smooth_thresh1"], config["smooth_thresh2"], config["smooth_hard_cap"]
    mild = t1 + (v - t1) / (1 + 3.0 * (v - t1) / (t2 - t1))
    strong = t2 + (v - t2) / (1 + 22.0 * F.pow((v - t2) / (1 - t2), 2))
    return F.least(F.lit(cap), F.when(v > t2, strong).when(v > t1, mild).otherwise(v))


def forecast_grid(params: DataFrame, points: int = 1000) -> DataFrame:
    """params (contest_id, tier, base .. panic, total_h, ..) at `points` equal steps from 0 to the end, with `skeleton`."""
    g = params.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("hours", F.col("i") * F.col("total_h") / (points - 1))
    return g.withColumn("skeleton", skeleton_shape(F.col("hours"), [F.col(c) for c in PARAMS], F.col("total_h")))


def skeleton_path(params: DataFrame, prefix: DataFrame, contests: DataFrame, scales: DataFrame, factors: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(contest_id, tier, now_h, score_now, strength, hours, gain): the growth curve with season and strength on the grid; gain is what a place from the last row on adds to the score.

    params: aligned and refitted (contest_id, tier, base .. panic); prefix: (contest_id, tier, hours, score).
    Targets without params are left out: no history, no forecast. Integration adds a full step at the first
    grid place at or after the last row, to the greatest score.
    """
    c = contests.select("contest_id", "start_at", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("total_h")).join(scales, "contest_id").withColumnRenamed("scale", "v10")
    now = prefix.groupBy(*K).agg(F.max("hours").alias("now_h"), F.max("score").alias("score_now"))
    p = params.drop("total_h").join(c, "contest_id").join(now, K)
    grid = apply_season(forecast_grid(p), factors, config)
    # strength: from 18 o'clock of the first day on
    local = F.pmod(F.col("start_at") + ZONE_MS, F.lit(24 * HOUR_MS)) / float(HOUR_MS)
    begin = p.select(*K, "v10", "now_h", F.greatest(F.lit(0.0), 18.0 - local).alias("begin"))
    own = prefix.join(begin, K).where("hours >= begin and now_h >= begin + 1")
    steps = hourly_deltas(own.select(*K, "hours", "score"))
    model = lookup_curve(steps.select(*K, "step", "delta", (F.col("lo") + 0.5).alias("hours")), grid.select(*K, "hours", "speed_norm"), value="speed_norm", out="v")
    strength = kalman_strength(model.join(begin, K).select(*K, "step", "delta", (F.col("v") * F.col("v10") * 60).alias("model")), config)
    g = grid.join(strength, K, "left").withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "trend": F.coalesce("trend", F.lit(0.0))})
    g = future_scale_curve(g, config).withColumn("speed", compress_speed(F.col("speed_norm") * F.col("curve"), config) * F.col("v10"))
    return g.select(*K, "now_h", "score_now", F.col("scale").alias("strength"), "hours", F.when(F.col("hours") >= F.col("now_h"), F.col("speed") * F.col("total_h") / 999 * 60).otherwise(0.0).alias("gain"))


def path_end(path: DataFrame) -> DataFrame:
    """(contest_id, tier, now_h, score_now, strength, final) of skeleton_path."""
    return path.groupBy(*K).agg(*[F.max(c).alias(c) for c in ("now_h", "score_now", "strength")], (F.max("score_now") + F.sum("gain")).alias("final"))


def forecast_skeleton(params: DataFrame, prefix: DataFrame, contests: DataFrame, scales: DataFrame, factors: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(contest_id, tier, now_h, score_now, strength, final): skeleton_path, integrated."""
    return path_end(skeleton_path(params, prefix, contests, scales, factors, config))


def what_if_path(targets: DataFrame, points: DataFrame, factors: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(contest_id, tier, segment, hours, score, norm_speed, is_manual): paths through assumed points, in steps of a tenth of an hour.

    targets: (contest_id, tier, base .. panic, total_h, start_at, v10, now_h, score_now); points: (contest_id,
    tier, hours, score), of which those later and higher than the last row count. A segment's modelled
    increment is scaled so that it ends at its point.
    """
    p = points.join(targets, K).where("hours > now_h and score > score_now")
    w = W.partitionBy(*K).orderBy("hours", "score")
    p = p.withColumns({"segment": F.row_number().over(w), "t0": F.coalesce(F.lag("hours").over(w), F.col("now_h")), "s0": F.coalesce(F.lag("score").over(w), F.col("score_now"))}).where("hours > t0")
    p = p.withColumnRenamed("hours", "t1").withColumnRenamed("score", "s1")
    n = F.ceil((F.col("t1") - F.col("t0")) / 0.1 - 1e-9).cast("int") - 1
    g = p.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("hours", F.col("t0") + F.col("i") * 0.1)
    g = g.withColumn("skeleton", skeleton_shape(F.col("hours"), [F.col(c) for c in PARAMS], F.col("total_h")))
    g = apply_season(g, factors, config)
    seg = W.partitionBy(*K, "segment")
    step = F.col("speed_norm") * F.col("v10") * 0.1
    raw = F.sum(step).over(seg)
    need = F.when(raw > 0, (F.col("s1") - F.col("s0")) / raw).otherwise(1.0)
    run = F.sum(step).over(seg.orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumns({"need": need, "run": run})
    return g.select(*K, "segment", "hours", (F.col("s0") + F.col("run") * F.col("need")).alias("score"), (F.col("speed_norm") * F.col("need") / 60).alias("norm_speed"), F.lit(True).alias("is_manual"))


def with_path(prefix: DataFrame, path: DataFrame) -> DataFrame:
    """(contest_id, tier, hours, score, is_manual): a prefix and what_if_path's rows behind it, for a forecast that goes on from the last assumed point."""
    return prefix.select(*K, "hours", "score", F.lit(False).alias("is_manual")).unionByName(path.select(*K, "hours", "score", "is_manual"))


def build_pace_prior(obs: DataFrame, contests: DataFrame, pressure: DataFrame, min_contests: int = 3, fraction: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prior, fits, excluded): contest-equal mean weights with the coverage gate's figures in one row; each contest's fit; (contest_id, reason) of the rest.

    Contests that the strict gate rejects are left out with its reasons; no_fit: no series has an increase.
    """
    gate = cut(strict_contest_gate(obs, contests))
    sound = obs.join(gate.where("accepted"), "contest_id", "left_semi")
    fits = cut(fit_pace_weights(cut(canonical_training_series(sound, contests)), contests, pressure))
    unfit = gate.where("accepted").join(fits, "contest_id", "left_anti").select("contest_id", F.lit("no_fit").alias("reason"))
    excluded = gate.where("not accepted").select("contest_id", F.col("reasons").alias("reason")).unionByName(unfit)
    covered = coverage_gate(contests, fits, min_contests, fraction).select("required", "passed", "excluded")
    return event_equal_mean(fits, ["w1", "w2", "w3"]).crossJoin(F.broadcast(covered)), fits, excluded  # one row each


def build_templates(obs: DataFrame, contests: DataFrame, pressure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates, excluded): cohort masses with what forecast_cohort needs; (contest_id, tier, reason) of the series that gave none.

    Reasons: the strict gate's, no_terminal (no row within 20 minutes after the end), terminal_below_maximum (that row is
    not the series' maximum), no_fit.
    """
    gate = cut(strict_contest_gate(obs, contests))
    rows = obs.join(contests.select("contest_id", "start_at", "end_at"), "contest_id").where(F.col("time_ms").between(F.col("start_at"), F.col("end_at") + GRACE_MS))
    after = F.col("time_ms") > F.col("end_at")
    ends = rows.groupBy(*K).agg(F.min_by(F.when(after, F.col("score")), F.when(after, F.col("time_ms"))).alias("terminal"), F.max(F.when(F.col("time_ms") < F.col("end_at"), F.col("score"))).alias("top"))
    why = F.when(~F.col("accepted"), F.col("reasons")).when(F.col("terminal").isNull(), "no_terminal").when(F.col("terminal") < F.col("top"), "terminal_below_maximum")
    known = cut(obs.select(*K).distinct().join(gate, "contest_id").join(ends, K, "left").select(*K, why.alias("reason")))
    good = known.where("reason is null").drop("reason")
    series = canonical_training_series(obs.join(good, K, "left_semi"), contests)
    masses = cut(fit_cohort_mass(mass_basis(series, contests), contests))
    unfit = good.join(masses, K, "left_anti").withColumn("reason", F.lit("no_fit"))
    templates = masses.join(contests.select("contest_id", "end_at", "contest_type"), "contest_id").join(pressure, K)
    return templates, known.where("reason is not null").unionByName(unfit)
