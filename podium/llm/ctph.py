"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a piece wherever it is -1 modulo the block size; every piece
gives one of 64 letters. The block size is 3 * 2**k, the least for which SIGNATURE pieces cover the text on
average, or smaller if too few boundaries come up. A fingerprint is k and the signatures at k and k + 1.
Fingerprints are compared at compatible block sizes (equal ones, or one twice the other) by edit distance:
1 - distance / longer length, the best of what can be compared; 0 where nothing can. The last letter covers
the rest of the text, so whole texts count.

Null texts are empty; empty texts have the fingerprint `0::`. The next document of the last is the first, a single
row's its own. Null ids come last, and rows of one id in the order of their texts' hashes; repeated rows keep a row
each. An empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of, partitions, span_hashes, text_chunks

WINDOW, SIGNATURE, LEVELS = 7, 64, 40
#: Code points of a range of documents, about.
RANGE_CHARS = 12_000_000
#: More ranges there are never: beyond, ranges grow instead (each is sorted with spilling and streams by), and what reaches the driver does not.
MOST_RANGES = 20_000
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.int64)
_CODE[LETTERS] = np.arange(64)
_BYTE = np.random.default_rng(77).integers(1, 2**32, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B1)
_LOW = np.uint64(0xFFFFFFFF)


def _levels(data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose rolling hash ends a piece at k = 0, and the largest k at which it does. text: which bytes are no padding."""
    v = np.where(text, _BYTE[data], np.uint64(0))
    h = v.copy()
    factor = np.uint64(1)
    for j in range(1, WINDOW):
        factor = factor * _STEP & _LOW
        h[j:] += v[:-j] * factor
    h &= _LOW
    h ^= h >> np.uint64(15)
    h = h * np.uint64(0x2C1B3C6D) & _LOW
    h ^= h >> np.uint64(13)
    h += np.uint64(1)
    at = np.flatnonzero((h % np.uint64(3) == 0) & text)
    m = h[at] // np.uint64(3)
    return at, np.minimum(np.log2((m & (~m + np.uint64(1))).astype(np.float64)), LEVELS - 1).astype(np.int64)


def fingerprints(texts: list[str | None]) -> list[str]:
    """The fingerprint of each text; it depends on the text alone."""
    out: list[str] = []
    for lo, hi in text_chunks(texts):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        pad = b"\0" * WINDOW
        data = np.frombuffer(pad.join(parts) + pad, np.uint8)
        size = np.array([len(p) for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum(size + WINDOW)])[:-1]
        text = np.ones(len(data), bool)
        for k in range(WINDOW):
            text[first + size + k] = False
        at, level = _levels(data, text)
        doc = np.searchsorted(first, at, "right") - 1
        n = len(parts)
        count = np.bincount(doc * LEVELS + level, minlength=n * LEVELS).reshape(n, LEVELS)[:, ::-1].cumsum(1)[:, ::-1]
        k = np.ceil(np.log2(np.maximum(size, 1) / (3 * SIGNATURE))).clip(0).astype(np.int64)
        while len(low := np.flatnonzero((k > 0) & (count[np.arange(n), np.minimum(k, LEVELS - 1)] < SIGNATURE // 2))):
            k[low] -= 1
        one, two = (_signatures(data, first, size, at, level, doc, k + d) for d in (0, 1))
        out += [f"{x}:{a}:{b}" for x, a, b in zip(k.tolist(), one, two, strict=True)]
    return out


def _signatures(data, first, size, at, level, doc, k) -> list[str]:
    on = level >= k[doc]
    ends, own = at[on] + 1, doc[on]
    nth = np.arange(len(own)) - np.searchsorted(own, own, "left")
    ends, own = ends[nth < SIGNATURE - 1], own[nth < SIGNATURE - 1]
    last = first + size
    closing = np.flatnonzero(size > 0)
    reached = np.zeros(len(first), np.int64)
    np.maximum.at(reached, own, ends)
    closing = closing[reached[closing] < last[closing]]  # what follows the last boundary is a piece, too
    ends, own = np.concatenate([ends, last[closing]]), np.concatenate([own, closing])
    order = np.lexsort((ends, own))
    ends, own = ends[order], own[order]
    starts = np.where(np.diff(own, prepend=-1) != 0, first[own], np.concatenate([[0], ends[:-1]])) if len(own) else ends
    letters = LETTERS[(span_hashes(data, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    cut = np.searchsorted(own, np.arange(len(first) + 1)).tolist()
    return [letters[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def distances(a: list[str], b: list[str], step: int = 4000) -> np.ndarray:
    """Edit distances of pairs of signatures (64 letters at most), all pairs at once: a bit for each letter of the one, a step for each of the other."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        n = len(x)
        m, t = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
        code = lambda s, size: _CODE[np.frombuffer("".join(v.ljust(SIGNATURE, "A") for v in s).encode(), np.uint8)].reshape(n, SIGNATURE)
        p, q = code(x, m), code(y, t)
        row, one = np.arange(n), np.uint64(1)
        mask = np.zeros((n, 64), np.uint64)
        for j in range(int(m.max(initial=0))):
            has = row[j < m]
            mask[has, p[has, j]] |= one << np.uint64(j)
        up, down = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
        top = one << np.maximum(m - 1, 0).astype(np.uint64)
        score = m.copy()
        for j in range(int(t.max(initial=0))):
            eq = mask[row, q[:, j]]
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            live = (j < t) & (m > 0)
            score += live * (((ph & top) != 0).astype(np.int64) - ((mh & top) != 0))
            ph, mh = ph << one | one, mh << one
            up, down = np.where(live, mh | ~(xv | ph), up), np.where(live, ph & xv, down)
        out[lo : lo + step] = np.where(m == 0, t, score)
    return out


def likeness(one: list[str], two: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    best = np.zeros(len(one))
    rows: list[int] = []
    left: list[str] = []
    right: list[str] = []
    for i, (f, g) in enumerate(zip(one, two, strict=True)):
        if f == g:
            best[i] = 1
            continue
        (k, a, b), (l, c, d) = f.split(":"), g.split(":")
        for x, y in {0: [(a, c), (b, d)], 1: [(a, d)], -1: [(b, c)]}.get(int(k) - int(l), []):
            if x and y:
                rows.append(i)
                left.append(x)
                right.append(y)
    longer = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)])
    np.maximum.at(best, np.array(rows, np.int64), 1 - distances(left, right) / longer if rows else np.zeros(0))
    return best


def place(keys: np.ndarray, hashes: np.ndarray, top_keys: np.ndarray, top_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each (key, hash), the first whose top is not below it, and whether it is that top; tops are sorted."""
    lo, hi = np.searchsorted(top_keys, keys, "left"), np.searchsorted(top_keys, keys, "right")
    out = lo.copy()
    tied = np.flatnonzero(hi > lo)
    for k in np.unique(keys[tied]):
        own = tied[keys[tied] == k]
        a, b = lo[own[0]], hi[own[0]]
        out[own] = a + np.searchsorted(top_hashes[a:b], hashes[own], "left")
    at = np.minimum(out, len(top_keys) - 1)
    return out, (out < len(top_keys)) & (top_keys[at] == keys) & (top_hashes[at] == hashes)


def in_order(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(bucket, borrowed, doc_id, text), dealt by ranges of (doc_id, hash of text) and sorted by these downwards within each.

    Each bucket ends with a borrowed row, the document that follows its last: the first of the next range,
    after the last range the first of all. The number of ranges follows the size of the texts up to MOST_RANGES, and hashes split
    an id that many rows have; only the ranges' upper ends (two numbers each) reach the driver.
    """
    key, text_hash = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    ranges = max(2 * partitions(docs.sparkSession), min(-(-chars // range_chars), MOST_RANGES))
    ids = docs.select(key.alias("key"), text_hash.alias("hash"))
    ends = ids.repartitionByRange(ranges, "key", "hash").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("key", "hash")).alias("top")).collect()
    tops = sorted({tuple(r["top"]) for r in ends})
    top_keys, top_hashes = np.array([t[0] for t in tops], np.int64), np.array([t[1] for t in tops], np.int64)

    @F.pandas_udf("bucket int, top boolean")
    def placed(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        bucket, top = place(keys.to_numpy(np.int64), hashes.to_numpy(np.int64), top_keys, top_hashes)
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "top": top})

    rows = docs.select(key.alias("key"), text_hash.alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", placed("key", "hash"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(0).alias("borrowed"))
    lent = F.struct(F.pmod(F.col("at.bucket") + 1, F.lit(max(len(tops), 1))).alias("bucket"), F.lit(1).alias("borrowed"))
    rows = rows.select(F.explode(F.when(F.col("at.top"), F.array(own, lent)).otherwise(F.array(own))).alias("to"), "key", "hash", "doc_id", "text")
    rows = rows.select("to.bucket", "to.borrowed", "key", "hash", "doc_id", "text").repartitionByRange(ranges, "bucket")  # about one bucket a task, where hashes would put several
    return rows.sortWithinPartitions("bucket", "borrowed", F.desc("key"), F.desc("hash")).drop("key", "hash")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how near these and the next document's are.

    Edited: the last floor(n/2) of n code points give way to the first as many of the next document by
    descending doc_id.
    """
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = arrow_schema(ddl)

    def rows(ids, texts, nexts, prints, next_prints):
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
        of_edited = fingerprints(edited)
        return batch_of(schema, [ids, [len(t) for t in texts], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], prints, of_edited, likeness(prints, of_edited), likeness(prints, next_prints)])

    def run(batches):
        held = None  # the row before, whose next has not come yet: bucket, id, text, fingerprint
        for b in batches:
            buckets, borrowed, ids, all_texts = (b.column(k).to_pylist() for k in range(4))
            for lo, hi in text_chunks(all_texts):
                texts = [t or "" for t in all_texts[lo:hi]]
                seq = list(zip(buckets[lo:hi], borrowed[lo:hi], ids[lo:hi], texts, fingerprints(texts), strict=True))
                if held is not None:
                    seq.insert(0, held)
                pairs = [(x, y) for x, y in zip(seq, seq[1:], strict=False) if not x[1] and x[0] == y[0]]
                held = seq[-1] if seq else None
                if pairs:
                    yield rows([x[2] for x, _ in pairs], [x[3] for x, _ in pairs], [y[3] for _, y in pairs], [x[4] for x, _ in pairs], [y[4] for _, y in pairs])

    return in_order(docs).mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
