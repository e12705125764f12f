"""BPE encoding and decoding by speculation: greedy longest match proposes tokens, pair checks verify them.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their
own bytes. So for each new word the longest tokens from the left are proposed; all neighbouring pairs of
all proposals are checked together with numpy, by undoing the merges of the two tokens from the latest on
and asking whether an earlier merge would have joined what then touches; words with a failing pair are
merged exactly, in rank order. Texts are cut into words as the tokenizer's file says: added tokens first,
then the byte-level pattern.

A null text is empty; every text, whatever its length, is encoded whole. Repeated rows and ids keep a row each, a null
doc_id too; an empty table gives none. Where several tokens could begin a word the longest is proposed, and merges
of one rank go from the left, as the tokenizer's do. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of

#: How byte-level tokenizers cut text into words, a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts below U+0100, where the classes are short.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_WIDE = re.compile("[\u0100-\U0010ffff]")
#: Words whose encodings a worker keeps; then it begins anew.
CACHE_WORDS = 700_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and their undoing, read from the text of a byte-level BPE tokenizer file."""

    def __init__(self, source: str):
        j = json.loads(source)
        model, letters = j["model"], byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.ids: dict[bytes, int] = {}
        self.bytes: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            if t not in self.added:
                self.ids[to_bytes(t)] = i
                self.bytes[i] = to_bytes(t)
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        n = len(model["merges"])
        self.left, self.right, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (to_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges.setdefault((x, y), (r, z))
            if self.rank[z] < 0:  # a token may be reachable by several merges; the first makes it
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.size, self.n_merges, self.longest = size, n, max(map(len, self.ids))
        self.pair_token = np.array([z for _, z in self.merges.values()], np.int64)[order]
        self.of_byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._trie()
        self.words, self.latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        self.cache: dict[str, bytes] = {}

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once, a byte of each in every step: their tokens in order, and the word of each."""
        size = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        end = np.cumsum(size)
        at = end - size
        live = np.flatnonzero(size)
        node, token, after = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), at.copy()
        rows, out = [], []
        while len(live):
            key = np.where(at[live] < end[live], node[live] * 256 + text[at[live]], -1)
            i = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            hit = self.trie_keys[i] == key
            on, off = live[hit], live[~hit]
            node[on] = i[hit] + 1
            at[on] += 1
            full = self.trie_token[i[hit]]
            own = on[full >= 0]
            token[own], after[own] = full[full >= 0], at[own]
            rows.append(off)
            out.append(token[off])
            at[off], node[off] = after[off], 0
            live = np.concatenate([on, off[at[off] < end[off]]])
        rows, out = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.int64)
        order = np.argsort(rows, kind="stable")
        return out[order], rows[order]

    def _trie(self) -> None:
        """Sorted keys (node * 256 + byte) of the prefixes of all tokens; the node behind the i-th key is i + 1, the root 0."""
        prefixes = sorted({t[:k] for t in self.ids for k in range(1, len(t) + 1)}, key=lambda t: (len(t), t))
        number = {b"": 0}
        keys = []
        for t in prefixes:  # shorter ones first and in byte order: the keys come out ascending
            number[t] = len(keys) + 1
            keys.append(number[t[:-1]] * 256 + t[-1])
        self.trie_keys = np.array(keys, np.int64)
        self.trie_token = np.array([self.ids.get(t, -1) for t in prefixes], np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: is it the encoding of its own bytes?

        Undo the later of the two tokens' last merges, the left token to its right part, the right one to its
        left part (of equal ranks the right one first, for equal merges go from left to right). What then
        touches must have no merge that comes before the one undone last; at equal rank the left place wins.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 2 * self.n_merges + 2, np.int64)  # twice the rank, odd: also equal ranks come first
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == key) & (2 * self.pair_rank[at] < limit[live])
            good[live[joins]] = False
            ra, rb = self.rank[x], self.rank[y]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            first = ra > rb
            nl, nr = live[go & first], live[go & ~first]
            limit[nl] = 2 * self.rank[a[nl]]
            a[nl] = self.right[a[nl]]
            limit[nr] = 2 * self.rank[b[nr]] + 1
            b[nr] = self.left[b[nr]]
            live = live[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the merge of lowest rank, leftmost first."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(out) > 64:
            return self._merge_long(out)
        while len(out) > 1:
            best = min(((m[0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if (m := self.merges.get(p))), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def _merge_long(self, out: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        n = len(out)
        nxt, prev, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(m[0], i, out[i], out[i + 1]) for i in range(n - 1) if (m := self.merges.get((out[i], out[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or out[i] != x or out[j] != y:
                continue
            out[i], gone[j], nxt[i] = self.merges[x, y][1], True, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] >= 0 and (m := self.merges.get((out[k], out[nxt[k]]))):
                    heapq.heappush(heap, (m[0], k, out[k], out[nxt[k]]))
        return [t for t, g in zip(out, gone, strict=True) if not g]

    def learn(self, words: list[str]) -> None:
        """Encodes words that the cache lacks: proposals, one check of all their pairs, exact merging for those that fail."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, owner = self.propose(raw)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, at = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[at]
        bad = np.unique(owner[inner[~fine]])
        again = self.merge_many([raw[k] for k in bad.tolist()])
        good = np.ones(len(words), bool)
        good[bad] = False
        for own, size, ids in ((np.flatnonzero(good), np.bincount(owner, minlength=len(words))[good], flat[good[owner]]), (bad, [len(p) for p in again], np.fromiter((t for p in again for t in p), np.int64))):
            packed, cut = ids.astype("<u4").tobytes(), np.concatenate([[0], 4 * np.cumsum(size)]).astype(int).tolist()
            self.cache.update(zip(map(words.__getitem__, own.tolist()), map(packed.__getitem__, map(slice, cut, cut[1:])), strict=True))

    def merge_many(self, words: list[bytes], step: int = 20_000) -> list[list[int]]:
        """Exact merging of many words at once, those of like length together: each round does every word's next merge."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo in range(0, len(order), step):
            own = order[lo : lo + step]
            short = [k for k in own if len(words[k]) <= 64]
            for k in own[len(short) :]:
                out[k] = self.merge(words[k])
            if short:
                for k, ids in zip(short, self._merge_rows([words[k] for k in short]), strict=True):
                    out[k] = ids
        return out

    def _lookup(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (beyond all, where there is none) and token of the merge of x and y; negative tokens have none."""
        key = np.where((x < 0) | (y < 0), -1, x * self.size + y)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], self.n_merges), np.where(hit, self.pair_token[at], -1)

    def _merge_rows(self, words: list[bytes]) -> list[list[int]]:
        width = max(map(len, words)) + 1
        size = np.array([len(w) for w in words])
        t = np.full((len(words), width), -1, np.int64)
        t[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank, into = (m.reshape(len(words), width - 1) for m in self._lookup(t[:, :-1].ravel(), t[:, 1:].ravel()))
        done: list = [None] * len(words)
        live = np.arange(len(words))
        cols = np.arange(width)
        while len(live):
            at = rank.argmin(1)
            go = rank[np.arange(len(live)), at] < self.n_merges
            for k, row, n in zip(live[~go].tolist(), t[~go].tolist(), size[live[~go]].tolist(), strict=True):
                done[k] = row[:n]
            live, t, rank, into, at = live[go], t[go], rank[go], into[go], at[go]
            if not len(live):
                break
            size[live] -= 1
            r = np.arange(len(live))
            z = into[r, at]
            shift = np.minimum(cols + (cols > at[:, None]), width - 1)
            t = np.take_along_axis(t, shift, 1)
            t[:, -1] = -1
            t[r, at] = z
            rank, into = np.take_along_axis(rank, np.minimum(shift[:, :-1], width - 2), 1), np.take_along_axis(into, np.minimum(shift[:, :-1], width - 2), 1)
            rank[r, -1] = self.n_merges
            rank[r, at], into[r, at] = self._lookup(z, np.where(at + 1 < width, t[r, np.minimum(at + 1, width - 1)], -1)) if width > 1 else (rank[r, at], into[r, at])
            before = np.maximum(at - 1, 0)
            has = np.flatnonzero(at > 0)
            rank[has, before[has]], into[has, before[has]] = self._lookup(t[has, before[has]], z[has])
        return done

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = []
        for t in texts:
            find = self.words.findall if t and _WIDE.search(t) else self.latin.findall
            parts = self.split.split(t or "") if self.split else [t or ""]
            cut.append([find(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        new = {w for parts in cut for p in parts[::2] for w in p} - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS and self.cache:
            self.cache.clear()
            new = {w for parts in cut for p in parts[::2] for w in p}
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(b"".join(map(get, p)) if i % 2 == 0 else self.added[p].to_bytes(4, "little") for i, p in enumerate(parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict[int, Vocabulary] = {}


def _vocabulary(source: str) -> Vocabulary:
    """The vocabulary and its word cache, kept by the worker from one task to the next."""
    key = hash(source)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Vocabulary(source)
    return _KEPT[key]


#: Code points that are cut into words at once.
STEP_CHARS = 2_000_000


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary, decoded string): the encoding of each text and what its ids decode to."""
    return _per_text(docs, path, "doc_id long, ids binary, decoded string", lambda ids, v, enc: [ids, enc, [v.decode(e) for e in enc]])


def _per_text(docs: DataFrame, path: str | None, ddl: str, columns) -> DataFrame:
    from podium.llm.common import text_chunks

    schema = arrow_schema(ddl)
    source = docs.sparkSession.sparkContext.broadcast(Path(path or vocabulary_file()).read_text(encoding="utf-8"))  # 1.6 MB, a fixed file

    def run(batches):
        v = _vocabulary(source.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_chunks(texts, STEP_CHARS):
                yield batch_of(schema, columns(ids[lo:hi], v, v.encode_all(texts[lo:hi])))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _per_text(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, v, enc: [ids, [len(e) // 4 for e in enc], [sha(e) for e in enc], [sha(v.decode(e).encode()) for e in enc]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
