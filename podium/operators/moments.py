"""Statistics of many windows over long series, from running moments instead of repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.schema import K

#: A deviation up to this counts as none; beyond it, rows within so many deviations of the mean make the trimmed mean.
FLAT, WIDE = 0.001, 2.0


def window_moments(rows: DataFrame, windows: DataFrame, ids: list[str]) -> DataFrame:
    """(*ids, contest_id, tier, lo, hi, n, mean, std, m, norm_mean) of every window [lo, hi] with a row of its series.

    rows: contest_id, tier, hours, skeleton_speed, norm_speed; windows: *ids (which name a window), contest_id, tier, lo, hi.
    n, mean and std (of a sample) are of the skeleton speeds, m and norm_mean of the others; nulls and NaNs don't
    count. Count, sum and sum of squares run along each series once, taken from the series' mean so that squares stay
    small; a window is the difference of what they are at its two ends. Rows are not repeated for windows: a series'
    rows and its windows' ends are sorted together.
    """
    finite = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    own = rows.select(*K, F.col("hours").cast("double").alias("x"), finite("skeleton_speed").alias("s"), finite("norm_speed").alias("v"))
    nothing = F.lit(None).cast(windows.select(F.struct(*ids, "lo", "hi").alias("w")).schema["w"].dataType)
    own = own.select(*K, "x", F.lit(1).alias("at"), "s", "v", nothing.alias("w"))
    none = F.lit(None).cast("double")
    w = windows.select(*K, F.struct(*ids, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).alias("w"))
    ends = F.explode(F.array(F.struct(F.col("w.lo").alias("x"), F.lit(0).alias("at")), F.struct(F.col("w.hi").alias("x"), F.lit(2).alias("at")))).alias("e")
    ends = w.select(*K, ends, "w").select(*K, "e.x", "e.at", none.alias("s"), none.alias("v"), "w")
    both = own.unionByName(ends)
    whole, run = W.partitionBy(*K), W.partitionBy(*K).orderBy("x", "at").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({"s0": F.coalesce(F.avg("s").over(whole), F.lit(0.0)), "v0": F.coalesce(F.avg("v").over(whole), F.lit(0.0))})
    both = both.withColumns({"s": F.col("s") - F.col("s0"), "v": F.col("v") - F.col("v0")})
    sums = {"n": F.count("s"), "a": F.sum("s"), "b": F.sum(F.col("s") * F.col("s")), "m": F.count("v"), "c": F.sum("v")}
    at_ends = both.select(*K, "at", "w", "s0", "v0", *[F.coalesce(v.over(run), F.lit(0)).alias(k) for k, v in sums.items()]).where("w is not null")
    sign = F.when(F.col("at") == 2, 1).otherwise(-1)
    g = at_ends.groupBy(*K, "w").agg(*[F.sum(F.col(k) * sign).alias(k) for k in sums], F.first("s0").alias("s0"), F.first("v0").alias("v0")).where("n > 0 or m > 0")
    spread = F.greatest(F.lit(0.0), F.col("b") - F.col("a") * F.col("a") / F.col("n"))
    return g.select(
        *[F.col(f"w.{i}").alias(i) for i in ids], *K, "w.lo", "w.hi", "n", F.try_add(F.col("s0"), F.try_divide("a", "n")).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std"), "m", F.try_add(F.col("v0"), F.try_divide("c", "m")).alias("norm_mean"),
    )


def window_statistics(rows: DataFrame, windows: DataFrame, ids: list[str]) -> DataFrame:
    """(*ids, contest_id, tier, intensity, norm_mean): window_moments, and the mean skeleton speed without outliers.

    Where the deviation is above FLAT, rows WIDE deviations or more from the mean are outliers. They are at most a
    quarter of a window's rows, and only their sums leave the tasks: the second pass joins a series' rows with its
    windows and adds the outliers up as they are found.
    """
    of = window_moments(rows, windows, ids)
    wide = of.where(F.col("std") > FLAT).select(*ids, *K, "lo", "hi", "mean", "std")
    far = F.abs(F.col("s") - F.col("mean")) >= WIDE * F.col("std")
    own = rows.where(~F.isnan("skeleton_speed")).select(*K, F.col("hours").cast("double").alias("x"), F.col("skeleton_speed").cast("double").alias("s"))
    out = wide.join(own, K).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")) & far)
    out = out.groupBy(*ids, *K).agg(F.count("*").alias("k"), F.sum(F.col("s") - F.col("mean")).alias("d"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"x.{c}")) for c in (*ids, *K)]
    j = of.alias("o").join(out.alias("x"), same, "left").select("o.*", "x.k", "x.d")
    inner = F.when(F.col("n") > F.col("k"), F.col("mean") - F.col("d") / (F.col("n") - F.col("k"))).otherwise(F.col("mean"))
    return j.select(*ids, *K, F.when(F.col("k").isNull(), F.col("mean")).otherwise(inner).alias("intensity"), "norm_mean")
