"""Running values along series of any length: local windows over segments, and a small scan that carries over their ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.session import cut


@dataclass(frozen=True)
class Run:
    """What to carry: before (the row before), last (the last value so far that is not null), next (the first one from here on), max or sum (so far)."""

    kind: str
    value: Column


def scan(df: DataFrame, keys: list[str], order: list[str], runs: dict[str, Run], partitions: int | None = None) -> DataFrame:
    """df with a column for each run, along the rows of equal keys in `order`; as plain windows give it, but no task holds a whole series.

    Rows are dealt into ranges of (keys, order), so a long series lies in many of them; each part of a series in a range
    is a segment. Segments hand on a row of what they carry, a window over these few rows gives each segment what comes
    in from before and after, and windows inside the segments do the rest. df is written once. Rows equal in keys and
    order are in any order, as in a plain window; keys may be null.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v_{out}": run.value for out, run in runs.items()}
    dealt = cut(df.withColumns(values).repartitionByRange(n, *keys, *order).withColumn("__segment", F.spark_partition_id()))
    # where a row stands: nulls first, as in a window
    at = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])
    held, carried, here = [], [], {}
    part = W.partitionBy(*keys).orderBy("__segment")
    own = W.partitionBy(*keys, "__segment").orderBy(*order)
    # what is next is what was last in the reverse order: frames up to the end would be read again for each row
    back, own_back = W.partitionBy(*keys).orderBy(F.desc("__segment")), W.partitionBy(*keys, "__segment").orderBy(*[F.desc(c) for c in order])
    before, after = (w.rowsBetween(W.unboundedPreceding, -1) for w in (part, back))
    so_far, from_here = (w.rowsBetween(W.unboundedPreceding, 0) for w in (own, own_back))
    for out, run in runs.items():
        v, c = F.col(f"__v_{out}"), f"__c_{out}"
        some = F.when(v.isNotNull(), F.struct(v.alias("x")))
        if run.kind == "before":
            held.append(F.max_by(F.struct(v.alias("x")), at).alias(c))
            carried.append(F.lag(c).over(part).alias(c))
            here[out] = F.when(F.row_number().over(own) == 1, F.col(f"{c}.x")).otherwise(F.lag(v).over(own))
        elif run.kind == "last":
            held.append(F.max_by(some, F.when(v.isNotNull(), at)).alias(c))
            carried.append(F.last(c, True).over(before).alias(c))
            here[out] = F.coalesce(F.last(v, True).over(so_far), F.col(f"{c}.x"))
        elif run.kind == "next":
            held.append(F.min_by(some, F.when(v.isNotNull(), at)).alias(c))
            carried.append(F.last(c, True).over(after).alias(c))
            here[out] = F.coalesce(F.last(v, True).over(from_here), F.col(f"{c}.x"))
        elif run.kind == "max":
            held.append(F.max(v).alias(c))
            carried.append(F.max(c).over(before).alias(c))
            here[out] = F.greatest(F.max(v).over(so_far), F.col(c))
        elif run.kind == "sum":
            held.append(F.sum(v).alias(c))
            carried.append(F.sum(c).over(before).alias(c))
            local = F.sum(v).over(so_far)
            here[out] = F.when(local.isNull(), F.col(c)).otherwise(local + F.coalesce(F.col(c), F.lit(0)))
        else:
            raise ValueError(f"no run of kind {run.kind}")
    carry = dealt.groupBy(*keys, "__segment").agg(*held).select(*keys, "__segment", *carried)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "__segment")]
    joined = dealt.alias("d").join(carry.alias("c"), same).select("d.*", *[f"c.__c_{out}" for out in runs])
    return joined.withColumns(here).drop("__segment", *values, *[f"__c_{out}" for out in runs])
