"""A table that grows by fetches or micro-batches, kept in buckets of its key: a change rewrites the buckets it touches.

    <folder>/data/batch=<b>/bucket=<k>/..     the rows of bucket k as of batch b
    <folder>/known/batch=<b>/bucket=<k>/..    a Bloom filter of the identities of bucket k, a row a word
    <folder>/commits/<b>                      which batch holds each bucket, a row a bucket

A batch first writes its new files, then its commit; readers follow the last whole commit. So a batch that is run
again after a failure writes the same files again, and one that is run again after its commit changes nothing.
Versions that neither of the last two commits needs are deleted. Any file system that Spark writes to will do.
The driver sees bucket numbers alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.schema import K

BUCKETS, WORDS = 32, 1 << 16
_VERSIONS = "contest_id long, tier int, time_ms long, score double, available_at long"
_LATEST = _VERSIONS + ", seq long"


@dataclass
class State:
    """The last commit: its batch (-1 before the first) and the batch that holds each bucket."""

    batch: int = -1
    held: dict[int, int] = field(default_factory=dict)


def _folder(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, at: str) -> list[str]:
    fs, path = _folder(spark, at)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _commits(spark: SparkSession, at: str) -> list[int]:
    """Whole commits, oldest first: Spark's writer marks a folder when all of it is there."""
    fs, _ = _folder(spark, at)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n) for n in _names(spark, f"{at}/commits") if fs.exists(path(f"{at}/commits/{n}/_SUCCESS")))


def _held(spark: SparkSession, at: str, batch: int) -> dict[int, int]:
    return {r["bucket"]: r["held"] for r in spark.read.schema("bucket int, held long").parquet(f"{at}/commits/{batch}").collect()}


def state(spark: SparkSession, at: str) -> State:
    found = _commits(spark, at)
    return State(found[-1], _held(spark, at, found[-1])) if found else State()


def read(spark: SparkSession, at: str, schema: str, buckets: list[int] | None = None, now: State | None = None, part: str = "data") -> DataFrame:
    """The table as of the last commit (or `now`), or the given buckets of it; no other bucket's files are opened."""
    now = now or state(spark, at)
    paths = [f"{at}/{part}/batch={b}/bucket={k}" for k, b in sorted(now.held.items()) if buckets is None or k in buckets]
    if not paths:
        return spark.createDataFrame([], schema + ", bucket int")
    return spark.read.schema(schema + ", bucket int").option("basePath", f"{at}/{part}").parquet(*paths).drop("batch")


def _commit(spark: SparkSession, at: str, batch: int, now: State, touched: list[int], parts: tuple[str, ...]) -> State:
    held = now.held | dict.fromkeys(touched, batch)
    spark.createDataFrame(sorted(held.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{at}/commits/{batch}")
    fs, _ = _folder(spark, at)
    path = spark._jvm.org.apache.hadoop.fs.Path
    kept = _commits(spark, at)[-2:]
    needed = {b for c in kept for b in (held if c == batch else _held(spark, at, c)).values()}
    old = [f"{at}/commits/{n}" for n in _names(spark, f"{at}/commits") if int(n) < min(kept)]
    old += [f"{at}/{p}/{n}" for p in parts for n in _names(spark, f"{at}/{p}") if int(n.split("=")[1]) not in needed and int(n.split("=")[1]) <= batch]
    for o in old:
        fs.delete(path(o), True)
    return State(batch, held)


def bucket_of(*columns: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


def _put(rows: DataFrame, at: str, batch: int, part: str = "data") -> None:
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{part}/batch={batch}")


def upsert(spark: SparkSession, at: str, batch: int, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], schema: str, keys: list[str], buckets: int = BUCKETS) -> State:
    """Puts a batch of rows into the store; `merge` makes of a bucket's old and new rows (with `bucket`) its rows. A batch at or before the last commit is left out."""
    now = state(spark, at)
    if batch <= now.batch:
        return now
    new = rows.withColumn("bucket", bucket_of(*keys, buckets=buckets)).persist()
    try:
        touched = _touched(new)
        if touched:
            _put(merge(read(spark, at, schema, touched, now).unionByName(new)), at, batch)
        return _commit(spark, at, batch, now, touched, ("data",))
    finally:
        new.unpersist()


# -- the newest revision of each time


def upsert_latest(spark: SparkSession, at: str, batch: int, rows: DataFrame, buckets: int = BUCKETS) -> State:
    """Keeps one row for each (contest, tier, time): of the greatest available_at, then seq. For foreachBatch: the store is the view, nothing is resolved on reading."""
    order = F.struct(F.col("available_at").isNotNull().alias("known"), "available_at", "seq", "score")

    def newest(both: DataFrame) -> DataFrame:
        g = both.groupBy("bucket", *K, "time_ms").agg(F.max(order).alias("o"))
        return g.select(*K, "time_ms", "o.score", "o.available_at", "o.seq", "bucket")

    return upsert(spark, at, batch, rows.select(*K, "time_ms", "score", "available_at", "seq"), newest, _LATEST, K, buckets)


def latest(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, _LATEST).select(*K, "time_ms", "score")


# -- all revisions, with the time each was first seen

_IDENTITY = [*K, "time_ms", "score"]


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64(*_IDENTITY), F.lit(words)).cast("int")


def _mask() -> Column:
    """Six of 64 bits, by a second hash: a filter of blocks of one word each, so that a look-up meets one row."""
    h = F.xxhash64(F.lit(1), *_IDENTITY)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(6)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def add_versions(spark: SparkSession, at: str, batch: int, fetched: DataFrame, observed_at: int | None = None, buckets: int = BUCKETS, words: int = WORDS) -> State:
    """Adds the revisions (contest, tier, time, score) that the store does not have, each with the time it was first seen.

    A row's own available_at counts, where it has one, else observed_at; an earlier time than the stored one replaces
    it. The filter of the fetched rows' buckets says which rows are new for sure; those that it may know are looked up
    in their buckets, by identity. Only buckets with new rows are read whole and rewritten, their filters too; what
    else the store holds is not opened.
    """
    now = state(spark, at)
    if batch <= now.batch:
        return now
    own = F.col("available_at") if "available_at" in fetched.columns else F.lit(None).cast("long")
    seen = F.coalesce(own, F.lit(observed_at)).cast("long")
    rows = fetched.select(*_IDENTITY, seen.alias("available_at")).groupBy(*_IDENTITY).agg(F.min("available_at").alias("available_at"))
    rows = rows.withColumns({"bucket": bucket_of(*K, buckets=buckets), "word": _word(words), "mask": _mask()}).persist()
    try:
        filters = read(spark, at, "word int, bits long", _touched(rows), now, "known")
        rows_ = rows.join(filters, ["bucket", "word"], "left")
        rows_ = rows_.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("bits").persist()
        maybe = rows_.where("maybe")
        known = read(spark, at, _VERSIONS, _touched(maybe), now).select("bucket", *_IDENTITY, F.col("available_at").alias("first"))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("bucket", *_IDENTITY)]
        later = maybe.alias("n").join(known.alias("k"), same, "left").where("k.bucket is null or n.available_at < k.first").select("n.*")
        new = rows_.where("not maybe").unionByName(later).drop("maybe").persist()
        try:
            dirty = _touched(new)
            if dirty:
                both = read(spark, at, _VERSIONS, dirty, now).unionByName(new.drop("word", "mask"))
                _put(both.groupBy("bucket", *_IDENTITY).agg(F.min("available_at").alias("available_at")).select(*_IDENTITY, "available_at", "bucket"), at, batch)
                bits = read(spark, at, "word int, bits long", dirty, now, "known").unionByName(new.select("word", F.col("mask").alias("bits"), "bucket"))
                _put(bits.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits")).select("word", "bits", "bucket"), at, batch, "known")
            return _commit(spark, at, batch, now, dirty, ("data", "known"))
        finally:
            new.unpersist()
            rows_.unpersist()
    finally:
        rows.unpersist()


def versions(spark: SparkSession, at: str) -> DataFrame:
    return read(spark, at, _VERSIONS).drop("bucket")
