"""Language ID: prediction by partial matching with frozen byte context trees, one for each language.

Text is lower-cased and encoded as UTF-8; runs of ASCII bytes that are not letters become one blank. For
each language a context tree of order 3 holds how often each symbol followed each context. A symbol's code
length is -log2 of its share in the longest context that has it, plus the escapes from the longer ones
(method C: with n symbols of d kinds a kind seen m times has m/(n+d), the escape d/(n+d)); below order 0
all 256 bytes are alike. The language with the shortest code wins. Since the statistics are frozen, the
code length of a symbol depends on its last three neighbours only, so whole texts are scored by table
lookups over the union of the trees.

The counts come from `per_lang` training documents of each language, taken by hash (a bounded sample of
labelled rows); all documents are scored over their whole texts. More than MAX_LANGS languages are an error: the
trees would not fit a task.

A null text or one without a letter is `und` with score 0; texts without a language, or held out, teach nothing. Of
languages with equal code lengths the first by name wins. Repeated rows and ids keep a row each, a null doc_id too.
Where nothing was learned all is `und`; an empty table gives none. Extra columns are not touched.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of, held_out, kept, text_chunks

ORDER, MAX_LANGS = 3, 300
#: Symbols before the others are numbered: 0 blank, 1 to 26 letters.
_FOLD = np.zeros(256, np.int32)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[128:] = np.arange(27, 155)
SYMBOLS = 155


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text followed (and the first preceded) by ORDER blanks of padding, and where each text begins."""
    pad = b"\0" * ORDER
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(pad + pad.join(parts) + pad, np.uint8)]
    size = np.array([len(p) for p in parts], np.int64)
    first = ORDER + np.concatenate([[0], np.cumsum(size + ORDER)[:-1]]) if len(parts) else np.zeros(0, np.int64)
    padding = np.zeros(len(data), bool)
    for k in range(ORDER):
        padding[first + size + k] = True
    padding[:ORDER] = True
    keep = padding | (data != 0)
    keep[1:] |= (data[:-1] != 0) & (data[1:] == 0)
    at = np.cumsum(keep) - keep
    return data[keep], at[first]


def _positions(starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols are text rather than padding, and the text of each."""
    ends = np.append(starts[1:], total) - ORDER
    mark = np.zeros(total + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:-1]) > 0, np.searchsorted(starts, np.arange(total), "right") - 1


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each window of ORDER + 1 symbols ends inside a text; docs has lang and text."""
    ddl = "lang string, gram long, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            out = []
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for lo, hi in text_chunks(own):
                    c, starts = encode(own[lo:hi])
                    real, _ = _positions(starts, len(c))
                    g = np.zeros(len(c), np.int64)
                    for k in range(ORDER, -1, -1):
                        g[ORDER:] = g[ORDER:] * SYMBOLS + c[ORDER - k : len(c) - k]
                    keys, n = np.unique(g[real], return_counts=True)
                    out.append((np.full(len(keys), lang, object), keys, n))
            if out:
                yield batch_of(schema, [np.concatenate(x) for x in zip(*out, strict=True)])

    return docs.select("lang", "text").mapInArrow(run, ddl).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """About per_lang documents of each language (all, where there are fewer), chosen by a hash of doc_id and text."""
    known = docs.where("lang is not null and text is not null").where(~held_out())
    counts = known.groupBy("lang").agg(F.count("*").alias("docs_of_lang")).select(F.col("lang").alias("of_lang"), "docs_of_lang")
    drawn = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    if counts.limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    return known.select("doc_id", "lang", "text").join(F.broadcast(counts), F.col("lang") == F.col("of_lang")).where(drawn * F.col("docs_of_lang") < per_lang).select("lang", "text")


class Trees:
    """The union of the languages' context trees as lookup tables: child[k] from a node of length k and a symbol to a node."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        size = len(self.langs)
        of = np.searchsorted(np.array(self.langs, object), lang) if size else np.zeros(0, int)
        if size:  # the padding before a text is a context, too, though nothing ends there
            of, gram, n = np.append(of, 0), np.append(gram, 0), np.append(n, 0.0)
        totals = np.zeros((SYMBOLS, size))
        np.add.at(totals, (gram % SYMBOLS, of), n)
        lower = self._costs(totals.sum(0)[None], (totals > 0).sum(0)[None], totals, np.zeros(SYMBOLS, int), np.full((SYMBOLS, size), 8.0))
        self.cost, self.escape, self.child = [lower], [np.zeros((1, size))], []
        ids = np.arange(SYMBOLS) + 1  # node of each known window of one symbol; 0 stands for unknown
        known = np.arange(SYMBOLS)
        for k in range(1, ORDER + 1):
            windows = gram % SYMBOLS ** (k + 1)
            nodes, at = np.unique(windows, return_inverse=True)
            counts = np.zeros((len(nodes), size))
            np.add.at(counts, (at, of), n)
            context = nodes // SYMBOLS
            contexts, c_at = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, c_at, counts)
            np.add.at(kinds, c_at, counts > 0)
            short = nodes % SYMBOLS**k
            below = self.cost[-1][(short if k == 1 else np.searchsorted(known, short) + 1)]
            cost = self._costs(total, kinds, counts, c_at, below)
            esc = np.zeros((len(ids) + 1 if k > 1 else SYMBOLS + 1, size))
            ok = total > 0
            e = np.where(ok, -np.log2(np.where(ok, kinds, 1) / np.where(ok, total + kinds, 1)), 0)
            place = contexts + 1 if k == 1 else np.searchsorted(known, contexts)
            if k > 1:  # every context of a window is itself a known window, or padding that never ended one
                hit = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == contexts)
                table = np.zeros((len(known) + 1) * SYMBOLS, np.int32)
                esc = np.zeros((len(known) + 1, size))
                esc[place[hit] + 1] = e[hit]
                row = np.searchsorted(known, context)
                fine = (row < len(known)) & (known[np.minimum(row, len(known) - 1)] == context)
                table[(row[fine] + 1) * SYMBOLS + nodes[fine] % SYMBOLS] = np.flatnonzero(fine) + 1
            else:
                table = np.zeros((SYMBOLS + 1) * SYMBOLS, np.int32)
                esc[place] = e
                table[(context + 1) * SYMBOLS + nodes % SYMBOLS] = np.arange(len(nodes)) + 1
            self.child.append(table)
            self.escape.append(esc)
            self.cost.append(np.concatenate([np.zeros((1, size)), cost]))
            known, ids = nodes, np.arange(len(nodes)) + 1
        self.cost = [c.astype(np.float32) for c in self.cost]
        self.escape = [c.astype(np.float32) for c in self.escape]

    @staticmethod
    def _costs(total, kinds, counts, context, below):
        """Bits of each (context, symbol): by its share where it was seen there, else the escape and the bits one order below."""
        t, d = total[context], kinds[context]
        seen, some = counts > 0, t > 0
        own = -np.log2(np.where(seen, counts, 1) / np.where(seen, t + d, 1))
        esc = -np.log2(np.where(some, d, 1) / np.where(some, t + d, 1))
        return np.where(seen, own, np.where(some, esc, 0) + below)

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text under each language, and its number of symbols."""
        out, length = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in text_chunks(texts):
            c, starts = encode(texts[a:b])
            nodes = [c + 1]
            for k in range(ORDER):
                nxt = np.zeros(len(c), np.int32)
                nxt[k + 1 :] = self.child[k][nodes[k][k : len(c) - 1].astype(np.int64) * SYMBOLS + c[k + 1 :]]
                nodes.append(nxt)
            real, doc = _positions(starts, len(c))
            at = np.flatnonzero(real)
            if not len(at):
                continue
            cost = self.cost[ORDER][nodes[ORDER][at]]
            left = np.flatnonzero(nodes[ORDER][at] == 0)
            for k in range(ORDER, 0, -1):  # from the longest context down, for those that none has coded
                p = at[left]
                cost[left] += self.escape[k][nodes[k - 1][p - 1]]
                hit = nodes[k - 1][p] > 0
                low = self.cost[k - 1][nodes[k - 1][p] if k > 1 else c[p]]
                cost[left[hit]] += low[hit]
                left = left[~hit]
            d = doc[at]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            out[a + d[first]] = np.add.reduceat(cost, first, axis=0, dtype=np.float64)
            length[a:b] = np.bincount(d, minlength=b - a)
        return out, length


def fit(docs: DataFrame, per_lang: int = 700) -> Trees:
    """Trees of the languages among the training documents; none where no training document has a language."""
    g = count_grams(sample(docs, per_lang)).toPandas()  # the distinct windows of a bounded sample
    g = g.sort_values(["lang", "gram"])
    return Trees(g["lang"].to_numpy(object), g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64))


def decide(trees: Trees, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share against the other languages, and bits a symbol in it. `und` (score 0): null, no letter, or nothing learned."""
    bits, length = trees.bits(texts)
    has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool) & (len(trees.langs) > 0)
    if not len(trees.langs):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = bits.argmin(1)
    least = bits[np.arange(len(texts)), best]
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    return [trees.langs[k] if h else "und" for k, h in zip(best, has, strict=True)], np.where(has, score, 0.0), least / np.maximum(length, 1)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_symbol) of each document; repeated rows and ids keep a row each."""
    ddl = "doc_id long, lang_pred string, score double, bits_per_symbol double"
    schema, shared = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield batch_of(schema, [b.column(0), *decide(shared.value, b.column(1).to_pylist())])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def keep_known(docs: DataFrame, trees: Trees, most_bits: float = 6.5) -> DataFrame:
    """The documents whose text some learned language explains: a letter, and at most most_bits bits a symbol. All columns stay.

    most_bits lies between what texts of a learned language take (on the test tables 1.3 to 4.9 bits a symbol, 99.9 %
    of them under 3.9) and the 7.3 that a symbol takes by chance.
    """
    schema, shared = arrow_schema_of(docs), docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        kept("language")
        for b in batches:
            if b.num_rows:
                lang, _, bits = decide(shared.value, b.column(at).to_pylist())
                yield b.filter(pa.array((np.array(lang, object) != "und") & (bits <= most_bits))).cast(schema)

    return docs.mapInArrow(run, docs.schema)


def arrow_schema_of(df: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
