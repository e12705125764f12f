"""The growth curve fitted to series of any length: Spark adds up moments, numpy solves a handful of unknowns for all series of a batch at once.

The curve is max(0, base + a t + b t^2 + rise). For a given length of the rise, and given rows where the floor at 0 is not
active, the rest is linear least squares, so a pass over the rows needs sums alone: moments of the active rows at a few
places (a length, and parameters that say which rows are active), and the loss at these places. Passes alternate: solve
at a grid of lengths, look at the losses, go on with a finer grid around the best; the last ones search the line between
the best parameters and the next solution, since rows may leave or enter the floor on the way. A pass is one aggregation
with map-side sums; a series is never in one buffer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions import numeric
from podium.schema import DEFAULTS, HOUR_MS, K
from podium.session import cut

PARAMS = ["base", "a", "b", "b_end", "panic"]
#: Lengths of the rise in the first grid and in each finer one; parts of the way to the next solution that are tried.
COARSE, FINE, LINE = 13, 17, (1.0, 0.5, 0.25, 0.1)
#: The first grid begins twice: with all rows active, and with those above this share of the series' mean, as a floor has several local minima.
LOW = 0.1
#: What the passes do with their sums, in order.
PASSES = ("solve", "solve", "zoom", "solve", "zoom", "solve", "line", "line", "end")


def rise_shape(t: Column, panic: Column, total: Column) -> Column:
    """The final rise of height 1: nothing until half of the last `panic` hours, then up to 1 at the end."""
    begin = total - panic
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    n = clip((t - begin) / panic)
    blend = clip((t - (begin - 4)) / F.greatest(F.lit(1e-6), panic / 2 + 4))
    return F.when(t > begin, F.pow(F.sin(n * (math.pi / 2)), 2.5) * F.pow(clip((n - 0.5) / 0.5), 3)).otherwise(0.0) * blend


def skeleton_shape(t: Column, p: list[Column], total: Column) -> Column:
    """The growth curve of parameters (base, a, b, b_end, panic): not below 0."""
    base, a, b, b_end, panic = p
    return F.greatest(F.lit(0.0), base + a * t + b * t * t + b_end * rise_shape(t, panic, total))


#: Where the 15 sums of a place have the products of (1, u, u^2, rise): u^0 .. u^4, rise u^0 .. u^2, rise^2, then y u^0 .. u^2, y rise, the loss, rows.
_GRAM = np.array([[0, 1, 2, 5], [1, 2, 3, 6], [2, 3, 4, 7], [5, 6, 7, 8]])
_SUMS = 15


def _sums(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(contest_id, tier, sums): 15 numbers for each place of a series, in order. Places without parameters take all rows for active, from the COARSE-th on the rows above `low`."""
    j = rows.join(state.select(*K, "total_h", "low", "lengths", "starts"), K)
    j = j.select(*K, "hours", "y", "total_h", "low", "starts", F.posexplode("lengths").alias("i", "panic"))
    u, y, at = F.col("hours") / F.col("total_h"), F.col("y"), lambda k: F.get("starts", F.col("i") * 4 + k)
    j = j.select(*K, "i", "y", "low", u.alias("u"), rise_shape(F.col("hours"), F.col("panic"), F.col("total_h")).alias("r"), *[at(k).alias(f"p{k}") for k in range(4)])
    u, r = F.col("u"), F.col("r")
    j = j.withColumn("v", F.col("p0") + F.col("p1") * u + F.col("p2") * u * u + F.col("p3") * r)
    active = F.coalesce(F.col("v") > 0, (F.col("i") < COARSE) | (y > F.col("low"))).cast("double")
    miss = y - F.greatest(F.col("v"), F.lit(0.0))  # without parameters: the loss of 0
    terms = [active, active * u, active * u * u, active * u * u * u, active * u * u * u * u, active * r, active * r * u, active * r * u * u, active * r * r]
    terms += [active * y, active * y * u, active * y * u * u, active * y * r, miss * miss, F.lit(1.0)]
    one = j.groupBy(*K, "i").agg(F.array(*[F.sum(t) for t in terms]).alias("s"))
    return one.groupBy(*K).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"])).alias("sums"))  # 2 * COARSE places at most


_STATE = "contest_id long, tier int, total_h double, low double, width double, lengths array<double>, starts array<double>, loss double, panic double, best array<double>, next array<double>"


def _pass(kind: str):
    """What follows from the sums of a pass: the best place so far, and the next places."""

    def one(r, sums: np.ndarray, solved: np.ndarray) -> tuple:
        lengths, starts = np.asarray(r.lengths), np.asarray(r.starts, float).reshape(-1, 4)
        loss, panic, best, ahead, width = r.loss, r.panic, r.best, r.next, r.width
        if len(starts):
            k = int(np.argmin(sums[:, 13]))
            if sums[k, 13] < loss:
                loss, panic, best, ahead = float(sums[k, 13]), float(lengths[k]), starts[k], solved[k]
        if kind == "solve":
            starts = solved
        elif kind == "zoom":
            hi = max(6.0, min(72.0, r.total_h / 2))
            lengths = np.unique(np.linspace(max(6.0, panic - width), min(hi, panic + width), FINE))
            starts, width = np.tile(ahead, (len(lengths), 1)), 2 * width / (FINE - 1)
        else:
            starts = np.asarray(best) + np.array(LINE)[:, None] * (np.asarray(ahead) - np.asarray(best))
            lengths = np.full(len(LINE), panic)
        return r.contest_id, r.tier, r.total_h, r.low, width, lengths, starts.ravel(), loss, panic, np.asarray(best, float), np.asarray(ahead, float)

    def run(batches):
        names = [c.split()[0] for c in _STATE.split(", ")]
        for pdf in batches:
            if not len(pdf):
                continue
            sums = [np.asarray(s, float).reshape(-1, _SUMS) for s in pdf["sums"]]
            every = np.concatenate(sums)
            total = np.repeat(pdf["total_h"].to_numpy(), [len(s) for s in sums])
            unit = np.stack([np.ones_like(total), total, total**2, np.ones_like(total)], 1)
            solved = numeric.box_least_squares_many(every[:, _GRAM], every[:, 9:13], numeric.SKELETON_LOWER * unit, numeric.SKELETON_UPPER * unit)
            parts = np.split(solved, np.cumsum([len(s) for s in sums])[:-1])
            yield pd.DataFrame([one(r, s, p) for r, s, p in zip(pdf.itertuples(index=False), sums, parts, strict=True)], columns=names)

    return run


def fit_skeleton(history: DataFrame, contests: DataFrame) -> DataFrame:
    """(contest_id, tier, base, a, b, b_end, panic, mse): the growth curve of each series of five finite points or more, by bounded least squares with the floor at 0.

    The rise is 6 hours long up to 72, or half the contest; contests under 12 hours have 6. Lengths are found to a
    64th of the first grid's step, which is a 12th of the range.
    """
    total = contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("total_h"))
    rows = cut(history.where("skeleton_speed is not null and abs(skeleton_speed) < double('infinity')").select(*K, "hours", F.col("skeleton_speed").cast("double").alias("y")))
    enough = rows.groupBy(*K).agg(F.count("*").alias("n"), (LOW * F.avg("y")).alias("low")).where("n >= 5").drop("n").join(total, "contest_id")
    width = F.greatest(F.lit(0.0), F.least(F.lit(72.0), F.col("total_h") / 2) - 6) / (COARSE - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(2 * COARSE - 1)), lambda k: 6 + k % COARSE * F.col("width"))
    none = F.array().cast("array<double>")
    state = enough.withColumn("width", width).withColumn("lengths", grid)
    state = state.withColumns({"starts": none, "loss": F.lit(math.inf), "panic": F.lit(6.0), "best": none, "next": none})
    for kind in PASSES:
        state = cut(state.join(_sums(rows, state), K).mapInPandas(_pass(kind), _STATE))
    n = rows.groupBy(*K).agg(F.count("*").alias("n"))
    p, t = (lambda k: F.get("best", F.lit(k))), F.col("total_h")
    return state.join(n, K).select(*K, p(0).alias("base"), (p(1) / t).alias("a"), (p(2) / (t * t)).alias("b"), p(3).alias("b_end"), "panic", (F.col("loss") / F.col("n")).alias("mse"))


_REFIT = "contest_id long, tier int, starts array<double>, loss double, best array<double>, next array<double>"


def _refit_sums(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """(contest_id, tier, sums): for each place q t^0 .. t^4 and q y t^0 .. t^2 of the active rows, and the weighted loss of all; means over all rows."""
    t, q, y = F.col("hours"), F.col("q"), F.col("y")
    if state is None:
        j = rows.withColumns({"i": F.lit(0), "curve": F.lit(None).cast("double")})
    else:
        at = lambda k: F.get("starts", F.col("i") * 3 + k)
        j = rows.join(state.select(*K, "starts"), K)
        j = j.withColumn("i", F.explode(F.sequence(F.lit(0), (F.size("starts") / 3).cast("int") - 1)))
        j = j.withColumn("curve", at(0) + at(1) * t + at(2) * t * t + F.col("bare"))
    active = F.when(F.col("curve").isNull() | (F.col("curve") > 0), q).otherwise(0.0)
    miss = F.col("skeleton_speed") - F.greatest(F.col("curve"), F.lit(0.0))
    terms = [active * F.pow(t, k) for k in range(5)] + [active * y * F.pow(t, k) for k in range(3)] + [q * miss * miss]
    one = j.groupBy(*K, "i").agg(F.array(*[F.avg(x) for x in terms]).alias("s"))
    return one.groupBy(*K).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"])).alias("sums"))


def refit_local(window: DataFrame, prior: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """prior (contest_id, tier, base .. panic, total_h) refitted to the target's own recent rows and blended by their confidence.

    window: refit_window's rows (hours, norm_speed, skeleton_speed, conf). Under refit_min_points the prior stays. Rows
    where the curve is below its floor pull no unknown; which these are follows from the solution, so where there are any
    the sums are made again for the places between one solution and the next, and the least loss stays.
    """
    prior = cut(prior.select(*K, *PARAMS, "total_h"))
    j = window.join(prior, K)
    bare = F.col("b_end") * rise_shape(F.col("hours"), F.col("panic"), F.col("total_h"))
    q = F.log1p(F.greatest(F.col("norm_speed"), F.lit(0.0)) * config["refit_weight_scale"])
    rows = cut(j.select(*K, "hours", "skeleton_speed", "conf", bare.alias("bare"), (F.col("skeleton_speed") - bare).alias("y"), q.alias("q")))
    about = rows.groupBy(*K).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("q").alias("mq"), F.avg(F.col("skeleton_speed") * F.col("skeleton_speed")).alias("vv"))
    about = about.where(F.col("n") >= config["refit_min_points"]).join(prior.select(*K, "base", "a", "b"), K)

    def step(kind: str):
        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    p, mq = np.array([r.base, r.a, r.b]), r.mq if r.mq > 0 else 1.0
                    lam = 2 * config["refit_lambda"] * (r.vv + 1e-6) / (p * p + 1e-9)
                    lo, hi = _refit_bounds(p, config)
                    s = np.asarray(r.sums, float).reshape(-1, 9) / mq
                    solved = [numeric.box_least_squares(x[np.add.outer(range(3), range(3))] + np.diag(lam), x[5:8] + lam * p, lo, hi) for x in s]
                    loss, best, ahead, starts = r.loss, r.best, r.next, np.array(solved)
                    if kind != "first":
                        at = np.asarray(r.starts, float).reshape(-1, 3)
                        every = s[:, 8] + ((at - p) ** 2 * lam).sum(1)
                        k = int(np.argmin(every))
                        if every[k] < loss:
                            loss, best, ahead = float(every[k]), at[k], solved[k]
                        starts = np.asarray(best) + np.array(LINE)[:, None] * (np.asarray(ahead) - np.asarray(best))
                    out.append((r.contest_id, r.tier, starts.ravel(), loss, np.asarray(best, float), np.asarray(ahead, float)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _REFIT.split(", ")])

        return run

    none = F.array().cast("array<double>")
    blank = about.withColumns({"starts": none, "loss": F.lit(math.inf), "best": none, "next": none})
    state = cut(blank.join(_refit_sums(rows, None), K).mapInPandas(step("first"), _REFIT))
    curve = F.get("starts", F.lit(0)) + F.get("starts", F.lit(1)) * F.col("hours") + F.get("starts", F.lit(2)) * F.col("hours") * F.col("hours") + F.col("bare")
    floored = rows.join(state.select(*K, "starts"), K).where(curve <= 0).select(*K).distinct()
    found = state.select(*K, F.col("starts").alias("x"))
    if not floored.isEmpty():
        floored = cut(floored)
        kept, more = cut(rows.join(floored, K, "left_semi")), state.join(floored, K, "left_semi")
        for _ in range(4):
            more = cut(more.join(about, K).join(_refit_sums(kept, more), K).mapInPandas(step("line"), _REFIT))
        found = found.join(floored, K, "left_anti").unionByName(more.select(*K, F.col("best").alias("x")))
    new = found.join(about.select(*K, "conf"), K)
    out = prior.drop("total_h").join(new, K, "left")
    blend = lambda c, k: F.when(F.col("x").isNull(), F.col(c)).otherwise((1 - F.col("conf")) * F.col(c) + F.col("conf") * F.get("x", F.lit(k))).alias(c)
    return out.select(*K, *[blend(c, k) for k, c in enumerate(PARAMS[:3])], "b_end", "panic")


def _refit_bounds(p: np.ndarray, config: dict = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """Bounds around the prior that keep its signs."""
    lo0, zero_ratio = max(0.0, config["refit_base_min_ratio"] * p[0]), config["refit_linear_zero_ratio"]
    signed = lambda v, near, far, zero: (v * far, min(v * zero_ratio, -1e-9)) if v < 0 else (max(v * near, 1e-9), v * far) if v > 0 else zero
    a = signed(p[1], zero_ratio, config["refit_linear_bound_scale"], (-1e-4, 1e-4))
    b = signed(p[2], config["refit_quad_min_ratio"], config["refit_quad_max_ratio"], (0.0, 1e-4))
    return np.array([lo0, a[0], b[0]]), np.array([max(lo0 + 1e-9, config["refit_base_max_ratio"] * p[0]), a[1], b[1]])
