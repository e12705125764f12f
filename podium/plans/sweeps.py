"""Sweeps of model configurations over the same snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.operators import models as M
from podium.plans import adapters as A
from podium.plans import replays as R
from podium.schema import DEFAULTS, K, violations
from podium.session import cut


def sweep_cohort(knots: DataFrame, templates: DataFrame, contests: DataFrame, truth: DataFrame, configs: list[tuple[float, bool]], holdout_from: int = 7, curve_weight: float = 0.5) -> DataFrame:
    """(config_id, split, objective): losses of cohort configurations (strength, transfer), all in one plan. A negative strength is rejected without a run.

    knots and truth meet by contest, tier and origin_h, a struct (origin, check): -1 is the end, others are places of the
    curve. The objective is snapshot_metrics': the mean over snapshots at the end, plus the weighted mean of the curve's.
    """
    good = [{"config_id": f"k{s:g}" + "t" * t, "strength": s, "transfer": t} for s, t in configs if s >= 0]
    rows = M.forecast_cohort(cut(knots), cut(templates), contests, configs=good).join(truth, [*K, "origin_h"]).withColumn("split", F.when(F.col("contest_id") >= holdout_from, "holdout").otherwise("train"))
    rel = (F.col("final") - F.col("actual")) / F.greatest(F.col("actual"), F.lit(1.0))
    last = F.col("origin_h.check") < 0
    snap = rows.groupBy("config_id", "split", *K, "origin_h.origin").agg(F.avg(F.when(last, rel * rel)).alias("end"), F.avg(F.when(~last, rel * rel)).alias("curve"))
    out = snap.groupBy("config_id", "split").agg((F.avg("end") + curve_weight * F.coalesce(F.avg("curve"), F.lit(0.0))).alias("objective"))
    bad = [(f"k{s:g}" + "t" * t) for s, t in configs if s < 0]
    if bad:
        out = out.unionByName(out.sparkSession.createDataFrame([(b, p, 1e6 + 1000.0) for b in bad for p in ("train", "holdout")], "config_id string, split string, objective double"))
    return out


def sweep_skeleton(spark, d: str, configs: dict[str, dict], holdout_from: int = 7, curve_weight: float = 0.5) -> DataFrame:
    """(config_id, split, objective): losses of skeleton configurations (settings over the defaults) on the snapshot plan.

    Runs, fits and checks are made once. A configuration that breaks constraints is not run; its loss says how many.
    """
    r = cut(R.runs(A.contests(spark, d), R.planned(spark, d)))
    shared = {"runs": r, "checks": cut(R.checks(spark, d))} | R.skeleton_inputs(spark, d, r)
    out, broken = [], []
    for name, own in configs.items():
        config = DEFAULTS | own
        if bad := violations(config):
            broken.append((name, 1e6 + 1000.0 * len(bad)))
            continue
        rows = R.snapshots(spark, d, config=config, shared=shared).where("status = 'success' and actual is not null")
        rel = (F.col("prediction") - F.col("actual")) / F.greatest(F.col("actual"), F.lit(1.0))
        split = F.when(F.col("contest_id") >= holdout_from, "holdout").otherwise("train")
        g = rows.groupBy(split.alias("split")).agg((F.avg(rel * rel) + curve_weight * F.coalesce(F.avg("curve_mse"), F.lit(0.0))).alias("objective"))
        out.append(g.select(F.lit(name).alias("config_id"), "split", "objective"))
    if broken:
        out.append(spark.createDataFrame([(n, p, x) for n, x in broken for p in ("train", "holdout")], "config_id string, split string, objective double"))
    return reduce(DataFrame.unionByName, out)
