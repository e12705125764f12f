"""Small helpers that the operators share: batching, byte hashing, checkpoints, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points that a task hands to numpy at once; a longer single text makes a chunk of its own.
CHUNK_CHARS = 1_500_000

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, and below them their inverses; kept by the worker and grown by doubling."""
    global _POWERS
    if _POWERS.shape[1] < n:
        p = np.repeat(np.array([[BASE], [INVERSE]]), 1 << max(16, (n - 1).bit_length()), axis=1)
        p[:, 0] = 1
        _POWERS = np.cumprod(p, axis=1)
    return _POWERS[:, :n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit words (xor-shift and multiply), so that every bit of the result is usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of a byte array; equal bytes give equal hashes wherever they stand."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[values] * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_chunks(texts: list[str | bytes | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold up to about `limit` code points together, all ranges about alike."""
    sizes = [len(t) + 1 if t else 1 for t in texts]
    total = sum(sizes)
    target = total / max(1, -(-total // limit))
    at, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= target:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def join_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 array, each followed by a line feed, and the offsets where each begins (and the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if parts else np.zeros(0, np.uint8), bounds


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x.type) for c, x in zip(columns, schema, strict=True)], schema=schema)


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; a local session that names none gets a new one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-checkpoint-"))


#: Spark's setting by which an action removes its shuffle files when it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives lost executors. Shuffle files that led to it go at once: nothing reads them again."""
    spark = df.sparkSession
    shared_folder(spark)
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint(True)  # a plan of its own, made under the setting
    finally:
        spark.conf.unset(CLEANED)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this Python worker keeps for an operator from task to task; what it kept for another one goes."""
    for other in [k for k in _KEPT if k != name]:
        del _KEPT[other]
    return _KEPT.setdefault(name, {})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text modulo 5 is 0; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of longs: (node, comp), comp the smallest node reachable.

    Alternating large-star and small-star steps: each round keeps at most as many edges as before, and
    stars of depth one are the fixed point, so chains of any length end after about log2 of it rounds.
    Every round is checkpointed; only counts and a checksum reach the driver. Self loops, nulls and
    repeated edges are dropped. No edges: no rows.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        # e has u > v. large: every neighbour of u above u is tied to the least of u and its neighbours;
        # small: the neighbours below u, and u, are tied to the least of them.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    e = checkpoint(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        e = checkpoint(star(star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def running(df: DataFrame, keys: list[str], order: list, **sums: str) -> DataFrame:
    """df with, for each name of `sums`, the sum of that column over the rows before in `order` among equal keys (not null).

    Rows are dealt into ranges of (keys, order); sums run inside a range, and each range adds what the ranges
    before it hold of its key. So a key of any size is spread over tasks; what is summed in one task is a row a
    range. Rows equal in keys and order stand in any order among themselves. df is written once.
    """
    p, *totals = fresh(df, "__p", *(f"__{n}" for n in sums))
    by = [*(F.col(k) for k in keys), *order]
    dealt = checkpoint(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn(p, F.spark_partition_id()))
    ahead = W.partitionBy(*keys).orderBy(p).rowsBetween(W.unboundedPreceding, -1)
    whole = dealt.groupBy(p, *keys).agg(*[F.sum(c).alias(t) for t, c in zip(totals, sums.values(), strict=True)])
    whole = whole.select(p, *keys, *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(t) for t in totals])
    before = W.partitionBy(p, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = {n: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(t) for (n, c), t in zip(sums.items(), totals, strict=True)}
    return dealt.join(whole, [p, *keys]).withColumns(out).drop(p, *totals)
