"""Exact quantiles of groups of any size: a sketch brackets each of them, and counting inside the bracket settles it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.session import cut

#: Ranks of the sketch are right to a part in so many; groups up to SMALL rows are counted whole.
ACCURACY, SMALL = 10_000, 50_000
#: Groups (about 200 bytes each) that are broadcast at most; more are joined by a shuffle, whose hot keys Spark splits.
BROADCAST_GROUPS = 50_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, names: dict[str, float], accuracy: int = ACCURACY, small: int = SMALL, broadcast: int = BROADCAST_GROUPS) -> DataFrame:
    """(*keys, n, <name>..): the linearly interpolated quantiles of each group, by the names and shares of `names`; nulls don't count, NaNs are above all.

    No group's values come together. The sketch (percentile_approx, which merges) is asked a little below and above
    each share; rows below the bracket are counted, those inside are counted by value, and a running sum over these
    finds the two neighbours. Inside are a few parts in `accuracy` of a group's rows. A bracket that missed its place,
    against the sketch's bound, is an error, never a wrong value. Groups without a value are left out. rows is read
    twice: give it checkpointed.
    """
    if small * 1.0 < 4 * accuracy:
        raise ValueError("small groups must hold at least four times `accuracy` rows, so that a rank is finer than the sketch")
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")
    step = 3.0 / accuracy
    probes = [p for q in names.values() for p in (max(0.0, q - step), min(1.0, q + step))]
    of = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, probes)), accuracy).alias("at")))
    spans = []
    for k, (name, q) in enumerate(names.items()):
        lo = F.when((F.col("n") > small) & F.lit(q > step), F.get("at", F.lit(2 * k)))
        hi = F.when((F.col("n") > small) & F.lit(q < 1 - step), F.get("at", F.lit(2 * k + 1)))
        spans.append(F.struct(F.lit(name).alias("name"), lo.alias("lo"), hi.alias("hi"), ((F.col("n") - 1) * F.lit(q)).alias("place")))
    of = of.select(*keys, "n", F.array(*spans).alias("spans"))
    groups = F.broadcast(of) if of.count() <= broadcast else of
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys] or F.lit(True)
    met = rows.alias("r").join(groups.alias("g"), same).select("g.*", "v").select(*keys, "n", "v", F.explode("spans").alias("s"))
    below = F.coalesce(F.col("v") < F.col("s.lo"), F.lit(False))
    met = met.where(~F.coalesce(F.col("v") > F.col("s.hi"), F.lit(False))).select(*keys, "n", "s.name", "s.place", (~below).alias("inside"), F.when(~below, F.col("v")).alias("v"))
    counts = met.groupBy(*keys, "n", "name", "place", "inside", "v").agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys, "name").orderBy("inside", "v").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(w))
    first, second = F.floor("place"), F.ceil("place")
    held = lambda k: F.max(F.when(F.col("inside") & (F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.col("v")))
    pair = counts.groupBy(*keys, "n", "name", "place").agg(held(first).alias("a"), held(second).alias("b"))
    got = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    got = got.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - first))
    return pair.withColumn("x", got).groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in names])
