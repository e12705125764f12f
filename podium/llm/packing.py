"""Packing: best-fit decreasing into windows of a fixed length, the open windows indexed by remaining capacity.

A document's ids (its tokens, then the end id) are cut into full windows and a remainder. The remainders
are dealt into groups of about `GROUP` pieces by a hash, so that tasks stay small whatever the input; in a
group the longest piece goes first into the tightest open window that holds it, which a segment tree over
the remaining capacities finds. A full window is a sequence of its own. A group leaves about one window
partly filled.

Null texts are empty: they have the end id alone. Repeated rows are packed once each. Long documents are
tokenized whole.
"""

from __future__ import annotations

import os
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.bpe import vocabulary_file
from podium.llm.common import arrow_schema, batch_of, checkpoint, kept, text_chunks

WINDOW, END_ID, GROUP = 2048, 1, 8192
CACHE_WORDS = 700_000
#: How the tokenizer's file cuts lower-cased texts below U+0100 into words (a fixed value); its library cuts the others.
_L, _N, _S = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_OTHER = re.compile("[Ā-\U0010ffff]|<\\|")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once while it is kept."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and END_ID as little-endian 32-bit integers."""
        cut = [None if t and _OTHER.search(t) else WORDS.findall((t or "").lower()) for t in texts]
        own = set().union(*(c for c in cut if c))
        new = own - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = own
        new = list(new)
        for k in range(0, len(new), 50_000):
            self.cache.update(zip(new[k : k + 50_000], self._ids(new[k : k + 50_000]), strict=True))
        get, end = self.cache.__getitem__, END_ID.to_bytes(4, "little")
        return [(self._ids([t])[0] if c is None else b"".join(map(get, c))) + end for t, c in zip(texts, cut, strict=True)]


def _encoder(source: str) -> WordEncoder:
    own = kept("packing")
    if (key := hash(source)) not in own:
        own.clear()
        own[key] = WordEncoder(source)
    return own[key]


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row[, ids]): each document's full windows and its remainder."""
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids binary" * with_ids
    schema = arrow_schema(ddl)
    source = docs.sparkSession.sparkContext.broadcast(Path(path or vocabulary_file("word_bpe_49k.json")).read_text(encoding="utf-8"))  # 1.7 MB, a fixed file

    def run(batches):
        from pyspark import TaskContext

        enc = _encoder(source.value)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_chunks(texts, 2_000_000):
                out = []
                for doc, e in zip(ids[lo:hi], enc.encode_all(texts[lo:hi]), strict=True):
                    n = len(e) // 4
                    for s in range(0, n, window):
                        part = e[4 * s : 4 * (s + window)]
                        out.append((doc, s, len(part) // 4, zlib.crc32(part), n, row, *([part] if with_ids else ())))
                        row += 1
                yield batch_of(schema, list(zip(*out, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


class Capacities:
    """A segment tree over capacities 0..window: which of them some open window has, and those windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        at = self.size + capacity
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open window of the smallest capacity of at least `least`, and that capacity; it is open no more."""
        at = self.size + least
        while not self.any[at]:
            while at & 1:  # up, until there is a subtree to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last of a level
                return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.size
        which = self.open[capacity].pop()
        if not self.open[capacity]:
            self.any[at] = 0
            while at > 1:
                at >>= 1
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
        return which, capacity


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; pieces go in by decreasing length."""
    free, n = Capacities(window), 0
    which, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = free.take(lengths[i])
        if found is None:
            found, n = (n, window), n + 1
        which[i], offset[i] = found[0], window - found[1]
        if found[1] > lengths[i]:
            free.add(found[1] - lengths[i], found[0])
    return which, offset


def pack(parts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. parts is read twice: give it checkpointed."""
    groups = max(1, -(-parts.count() // group))
    ddl = ", ".join(f"{c} {t}" for c, t in parts.dtypes if c != "row") + ", sequence_id long, offset long"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        which, offset = best_fit(pdf["length"].tolist(), window)
        return pdf.drop(columns=["row", "bucket"]).assign(sequence_id=(int(key[0]) << 32) + np.array(which, np.int64), offset=np.array(offset, np.int64))

    return parts.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("bucket").applyInPandas(run, ddl)


def packed(docs: DataFrame) -> DataFrame:
    return pack(checkpoint(pieces(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
