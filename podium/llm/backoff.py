"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash.

A text is BOS w1 .. wn EOS. The score of a word is count(gram)/count(context) for the longest gram of up to
`order` words that ends at it and occurs at least MIN_COUNT times in the corpus, times BACKOFF for each word
that the gram was shortened by; a single word has count(word)/events. A document's score is the mean logarithm
over its n + 1 events. Counts are those of all documents.

1. `exploded`: consecutive documents make chunks of bounded size. A chunk's distinct grams, with how often it
   has them, are dealt to `parts`, which are ranges of the grams' 64-bit hashes; the chunk's own words go along
   as places among its distinct words.
2. `joined`: a part is a piece of the count tables and of the exploded grams alike. It adds up what the chunks
   have and sends each chunk the corpus counts of its grams.
3. `scored`: a chunk has the counts of all its grams, scores its events and sums them by document.

A gram is one entry a chunk, however frequent it is, so no word or pair makes a part large: parts are even as
hashes are. Grams travel as sorted arrays, by differences; a row for each would take more disk than the texts
do. Rows are chunks times parts, of at least one gram each. The driver gets one number, the corpus' size.

Words are runs of anything but the ASCII blanks, A-Z in lower case. Grams are known by 64 bits: some of
10 ** 10 distinct ones share a hash with even odds, which adds their counts. Documents without words (null texts
too) have no score. Repeated rows count, and are scored, once each; a null doc_id is a document like others.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of, join_bytes, mix, span_hashes, text_chunks

ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
#: Code points from which a chunk is full (a batch more at most), and those of the corpus for each part; the fewest parts.
CHUNK, PART_CHARS, LEAST_PARTS = 6_000_000, 20_000_000, 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
BOS, EOS = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
#: The gram of no words: how many events there are.
NONE = np.uint64(0)


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text between BOS and EOS, and how many each text has with those; texts without words have none."""
    data, bounds = join_bytes(texts)
    data = _LOWER[data]
    inside = np.diff((~_BLANK[data]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    w = span_hashes(data, starts, ends)
    n = np.diff(np.searchsorted(starts, bounds))
    size = np.where(n > 0, n + 2, 0)
    at = np.cumsum(size)
    out = np.zeros(int(at[-1]) if len(at) else 0, np.uint64)
    first, last = (at - size)[n > 0], at[n > 0] - 1
    body = np.ones(len(out), bool)
    body[first] = body[last] = False
    out[body], out[first], out[last] = w, BOS, EOS
    return out, size


def grams(words: np.ndarray, size: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order the hash of the k words that end at each place; where a document has fewer before it, that of all of them."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    out = [words]
    for k in range(2, order + 1):
        longer = out[-1].copy()
        fit = np.flatnonzero(place >= k - 1)
        longer[fit] = mix(out[-1][fit] * np.uint64(0x9E3779B97F4A7C15) + mix(words[fit - k + 1] + np.uint64(k)))
        out.append(longer)
    return out


def planes(a: np.ndarray) -> bytes:
    """The bytes of equal weight of all numbers together, compressed: high ones are mostly zero. The length comes first."""
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def numbers(b: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


_ROWS = "part long, chunk long, keys binary, counts binary, ids binary, known binary, size binary"


def exploded(docs: DataFrame, parts: int, order: int = ORDER, chunk_chars: int = CHUNK) -> DataFrame:
    """Rows (part, chunk, keys, counts): a chunk's grams of a part; with part -1 - chunk: its distinct words, the places of its words among them, and its documents."""
    schema = arrow_schema(_ROWS)

    def rows(chunk: int, ids: list, texts: list):
        words, size = (np.concatenate(x) for x in zip(*(sequences(texts[lo:hi]) for lo, hi in text_chunks(texts)), strict=True))
        every = grams(words, size, order)
        own, at = np.unique(words, return_inverse=True)
        number = np.array([0 if i is None else i for i in ids], "<i8")
        yield (-1 - chunk, chunk, planes(np.diff(own, prepend=NONE)), planes(at.astype("<u4")), number.tobytes(), bytes(i is not None for i in ids), planes(size.astype("<u4")))
        keys, counts = np.unique(np.concatenate(every[:1] + [g[g != h] for g, h in zip(every[1:], every, strict=False)]), return_counts=True)
        keys, counts = np.append(NONE, keys), np.append((size > 0) @ (size - 1), counts)
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(parts + 1)).tolist()
        for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
            if y > x:
                yield (p, chunk, planes(np.diff(keys[x:y], prepend=NONE)), planes(counts[x:y].astype("<u4")), None, None, None)

    def run(batches):
        from pyspark import TaskContext

        chunk, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal chunk, ids, texts, held
            out = list(rows(chunk, ids, texts))
            chunk, ids, texts, held = chunk + 1, [], [], 0
            for k in range(0, len(out), 64):
                yield batch_of(schema, list(zip(*out[k : k + 64], strict=True)))

        for b in batches:
            new_ids, new = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_chunks(new, chunk_chars):
                chars = sum(len(t) + 1 if t else 1 for t in new[lo:hi])
                ids, texts, held = ids + new_ids[lo:hi], texts + new[lo:hi], held + chars
                if held >= chunk_chars:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def joined(rows: DataFrame) -> DataFrame:
    """The rows of exploded, with the corpus counts of each chunk's grams in the place of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return pdf
        keys = [np.cumsum(numbers(k, "<u8")) for k in pdf["keys"]]
        counts = np.concatenate([numbers(c, "<u4") for c in pdf["counts"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        of_all = np.bincount(at, counts).astype("<u8")[at]  # whole numbers up to 2 ** 53
        cut = np.cumsum([len(k) for k in keys])[:-1]
        return pdf.assign(keys=None, counts=[planes(c) for c in np.split(of_all, cut)])

    return rows.groupBy("part").applyInPandas(run, _ROWS)


def scored(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_events, score): the events of each chunk's documents, by the counts of its grams."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["part"] < 0].iloc[0]
        counts = np.concatenate([numbers(c, "<u8") for c in pdf[pdf["part"] >= 0].sort_values("part")["counts"]])
        words, size = np.cumsum(numbers(own["keys"], "<u8"))[numbers(own["counts"], "<u4")], numbers(own["size"], "<u4").astype(np.int64)
        every = grams(words, size, order)
        keys = np.append(NONE, np.unique(np.concatenate(every)))
        n = [counts[np.searchsorted(keys, g)] for g in every]
        begins = np.cumsum(size) - size
        place = np.arange(len(words)) - np.repeat(begins, size)
        value = np.log(n[0] / max(int(counts[0]), 1)) if len(words) else np.zeros(0)
        for k in range(2, order + 1):
            fit = np.flatnonzero(place >= k - 1)
            seen = n[k - 1][fit] >= MIN_COUNT
            value[fit] += np.log(BACKOFF)
            value[fit[seen]] = np.log(n[k - 1][fit[seen]] / n[k - 2][fit[seen] - 1])
        value[place == 0] = 0  # BOS is no event
        events = np.maximum(size - 1, 0)
        sums = np.add.reduceat(np.append(value, 0.0), begins)
        ids, known = np.frombuffer(own["ids"], "<i8"), np.frombuffer(own["known"], bool)
        return pd.DataFrame({"doc_id": ids, "known": known, "n_events": events, "score": np.where(events > 0, sums / np.maximum(events, 1), 0.0)})

    out = rows.groupBy("chunk").applyInPandas(run, "doc_id long, known boolean, n_events long, score double")
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_events", F.when(F.col("n_events") > 0, F.col("score")).alias("score"))


def scores(docs: DataFrame, order: int = ORDER, part_chars: int = PART_CHARS, chunk_chars: int = CHUNK) -> DataFrame:
    """(doc_id, n_events, score) of each row of docs. order: most words of a gram, from 2."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-chars // part_chars))
    return scored(joined(exploded(docs, parts, order, chunk_chars)), order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return s.select("doc_id", "n_events", F.round("score", 6).alias("score"))


ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), q AS (
  SELECT doc_id, list_concat(list_concat([' bos'], words), [' eos']) AS s FROM w WHERE len(words) > 0
), e AS (
  SELECT doc_id, unnest(s[1:len(s)-1]) AS a, unnest(s[2:len(s)]) AS b FROM q
), c2 AS (
  SELECT a, b, count(*) AS n FROM e GROUP BY a, b
), ca AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
), cb AS (
  SELECT b, count(*) AS n FROM e GROUP BY b
), t AS (
  SELECT count(*) AS n FROM e
), v AS (
  SELECT c2.a, c2.b, CASE WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n / ca.n) ELSE ln({BACKOFF}::DOUBLE * cb.n / t.n) END AS s
  FROM c2 JOIN ca USING (a) JOIN cb USING (b) CROSS JOIN t
), d AS (
  SELECT e.doc_id, count(*) AS n, avg(v.s) AS s FROM e JOIN v USING (a, b) GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_events, round(d.s, 6) AS score FROM w LEFT JOIN d USING (doc_id)
"""
