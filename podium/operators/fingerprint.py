"""Fingerprints of series as ordered trees of digests: a late row changes one branch, and no series comes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.schema import HOUR_MS

#: Time of a leaf, children of a node, and levels above the leaves: the last one spans some thirty years of hours.
LEAF_MS, FAN, LEVELS = HOUR_MS, 64, 3


def _joined(order: list, value: Column) -> Column:
    """Values by order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("value")))), lambda x: x["value"]), ",")


def digest_tree(rows: DataFrame, keys: list[str], item: Column, order: list[str], time: str = "time_ms", leaf_ms: int = LEAF_MS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(*keys, level, node, n, digest): every node of the trees of rows of equal keys; n counts its rows. Level 0 are the leaves, and the one node of level `levels` + 1 is the root.

    A leaf holds the rows of leaf_ms, its digest is SHA-256 of their items in `order`; a node's is that of its children's
    (number:digest) by number. So what is collected is a leaf's rows or a node's `fan` children. Rows of no time are in no
    tree; equal rows in order are told apart by their items.
    """
    leaves = rows.where(F.col(time).isNotNull()).withColumn("node", F.floor(F.col(time) / leaf_ms))
    level = leaves.groupBy(*keys, "node").agg(F.count("*").alias("n"), F.sha2(_joined([F.col(c) for c in order], item), 256).alias("digest"))
    out = level.select(*keys, F.lit(0).alias("level"), "node", "n", "digest")
    child = F.concat_ws(":", F.col("node").cast("string"), "digest")
    for k in range(1, levels + 2):
        up = F.floor(F.col("node") / fan) if k <= levels else F.lit(0).cast("long")
        level = level.groupBy(*keys, up.alias("up")).agg(F.sum("n").alias("n"), F.sha2(_joined([F.col("node")], child), 256).alias("digest")).withColumnRenamed("up", "node")
        out = out.unionByName(level.select(*keys, F.lit(k).alias("level"), "node", "n", "digest"))
    return out


def roots(tree: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """(*keys, n, fingerprint) of whole series."""
    return tree.where(F.col("level") == levels + 1).select(*keys, "n", F.col("digest").alias("fingerprint"))


def changed_leaves(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node): the leaves that two trees of the same shape do not share, on either side."""
    leaf = lambda t: t.where("level = 0").select(*keys, "node", "digest")
    a, b = leaf(old), leaf(new)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(*keys, "node").distinct()
