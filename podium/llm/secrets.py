"""Secret scans: a random forest removes the false positives among strings that look like secrets.

Candidates are of three kinds. A part, of at least MIN_LENGTH, of a run of the characters that keys consist of:
parts lie between `=`, `:` and `@` (a part with short pieces around its `@` stays whole), and the run has a digit
or mixed case in it, or the part a known key format. And a value of at least MIN_SHORT bytes of any kind that a
key word and `=` or `:` announce, such as a password. A block between a BEGIN and an END line, such as a private key
or a certificate, is one candidate, which nothing in it is besides. Shorter ones, and runs of lower-case letters alone
that nothing announces, are not scanned.

Features: length and character shares, entropy, transitions between character classes and the surprise of letter
pairs, the share covered by dictionary words, known formats, the path, and the neighbouring words. The forest learns from
labelled findings, that is rows (text, start, end, path, label): reviewed ones, or secrets and look-alikes
planted in the corpus' own texts (`planted`; about `FINDINGS`, a bounded sample for the fit), of which `split`
holds a fifth out; `unseen_kinds` holds out whole kinds of them. The dictionary (the `DICTIONARY_WORDS` most frequent words) and the letter pairs count all
documents; every whole text is scanned.

Null texts have no findings, null paths none of a path's features; repeated rows give repeated findings; an empty
table gives none, and a corpus without texts a model that finds nothing. Findings of a text do not overlap.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.llm import planted
from podium.llm.common import arrow_schema, batch_of, join_bytes, span_hashes, text_chunks
from podium.llm.forest import Forest
from podium.session import cut

MIN_LENGTH, MIN_SHORT, LEVEL = 12, 6, 0.5
DICTIONARY_WORDS, FINDINGS = 3000, 6000
MASK = "[SECRET]"

_CHARS = np.zeros(256, bool)
_CHARS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.@:-", np.uint8)] = True
_KIND = np.zeros(256, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4
#: Words that announce a secret, and such as stand in examples.
KEYWORDS = re.compile(r"(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)\W{0,4}$", re.I)
EXAMPLES = re.compile(r"example|sample|dummy|placeholder|changeme|your[_-]|x{4}|test", re.I)
#: Known key formats, anywhere in bytes.
KNOWN_IN = re.compile(
    rb"(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    rb"|(?<![A-Za-z0-9_-])[sr]k-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.)"
)
#: A block between a BEGIN and an END line; it ends at the next five hyphens, so no text is read twice.
BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]{1,40}-----(?:[^-]|-(?!----)){16,}-----END [A-Z0-9 ]{1,40}-----")
PRIVATE = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY")
#: Names of digests, before a value or at its beginning.
DIGESTS = re.compile(r"(commit|sha-?\d{1,3}|md5|checksum|etag|digest|integrity|revision|blob|hash)\W{0,4}$", re.I)
DIGEST_IN = re.compile(rb"(sha\d{1,3}|md5)[-_]", re.I)
_BEFORE = re.compile(rb"(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth|credentials?|private[_-]?key)[\"'` ]{0,2}$", re.I)
_VALUE = re.compile(rb"[ \t]{0,3}[\"'`]?([^\s\"'`,;<>(){}\[\]]{%d,})" % MIN_SHORT)
_LAST = np.zeros(256, bool)  # what an announcing word ends with, or stands between it and the sign
_LAST[np.frombuffer(b"dDeEtTnNyYhHlLsS\"'` ", np.uint8)] = True


def parts(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that are long enough."""
    out = []
    for m in re.finditer(rb"[^=:]+", run):
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(rb"[^@]+", m[0])]
        long = [(a, b) for a, b in pieces if b - a >= MIN_LENGTH]
        out += long or [(a, b) for a, b in [m.span()] if b - a >= MIN_LENGTH]
    return out


def announced(data: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the values that a key word and a sign announce, in order; of two that overlap the inner one."""
    at = np.flatnonzero((data == 61) | (data == 58))
    at = at[at > 0]
    at = at[_LAST[data[at - 1]]].tolist()
    raw = data.tobytes() if at else b""
    out: list[tuple[int, int]] = []
    for i in at:
        if _BEFORE.search(raw, max(0, i - 20), i) and (m := _VALUE.match(raw, i + 1)):
            lo, hi = m.start(1), m.start(1) + len(m[1].rstrip(b".:=-/@"))
            if hi - lo >= MIN_SHORT:
                if out and lo < out[-1][1]:
                    out.pop()
                out.append((lo, hi))
    return out


def candidates(texts: list[str | None]) -> list[tuple[int, bytes, int, int]]:
    """(index of text, its bytes, start, end) of each candidate value, in order; offsets count bytes."""
    out = []
    for a, b in text_chunks(texts):
        data, bounds = join_bytes(texts[a:b])
        inside = np.diff(_CHARS[data].astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        long = ends - starts >= MIN_LENGTH
        starts, ends = starts[long], ends[long]
        kind = _KIND[data]
        digits, upper, lower = (np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2, 3))
        within = lambda c: c[ends] - c[starts]
        odd = (within(digits) > 0) | ((ends - starts >= 20) & (within(upper) > 1) & (within(lower) > 1))
        raw = data.tobytes()
        known = np.array([m.start() for m in KNOWN_IN.finditer(raw)], np.int64)
        run = np.searchsorted(starts, known, "right") - 1
        keep = odd.copy()
        keep[run[(run >= 0) & (known < np.append(ends, 0)[run])]] = True
        told = [(x, y) for x, y in (m.span() for m in BLOCK.finditer(raw)) if np.searchsorted(bounds, x, "right") == np.searchsorted(bounds, y - 1, "right")]  # inside one text
        ends_of = [y for _, y in told]
        for x, y in announced(data):  # what overlaps a block is a part of it
            k = bisect_right(ends_of, x)
            if k == len(ends_of) or y <= told[k][0]:
                told.append((x, y))
        told.sort()
        spans = list(told)
        for s, e, o in zip(starts[keep].tolist(), ends[keep].tolist(), odd[keep].tolist(), strict=True):
            text = raw[s:e].rstrip(b".:=-/@")
            spans += [(s + x, s + y) for x, y in parts(text) if o or KNOWN_IN.search(text, x, y)]
        if told:  # what an announced value overlaps is a part of it
            lo, hi = np.array(told).T
            first = np.searchsorted(hi, [s for s, _ in spans], "right")
            spans = told + [x for x, k in zip(spans[len(told) :], first[len(told) :].tolist(), strict=True) if k == len(lo) or x[1] <= lo[k]]
        spans.sort()
        at, own = -1, b""
        doc = (np.searchsorted(bounds, [s for s, _ in spans], "right") - 1).tolist()
        for d, (s, e) in zip(doc, spans, strict=True):
            if d != at:  # a text's candidates share one copy of it
                at, own = d, raw[bounds[d] : bounds[d + 1] - 1]
            out.append((a + d, own, s - int(bounds[d]), e - int(bounds[d])))
    return out


def _windows(words: list[bytes]) -> dict[int, np.ndarray]:
    """Sorted hashes of the words of each length."""
    by: dict[int, list[bytes]] = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    ends = {n: np.arange(1, len(ws) + 1) * n for n, ws in by.items()}
    return {n: np.sort(span_hashes(np.frombuffer(b"".join(ws), np.uint8), ends[n] - n, ends[n])) for n, ws in by.items()}


def featurise(found: list[tuple[bytes, int, int, str | None]], model: dict) -> np.ndarray:
    """A row of features for each candidate (text, start, end, path), from its characters, the dictionary, the path and the words before and after."""
    if not found:
        return np.zeros((0, 1))
    size = np.array([e - s for _, s, e, _ in found])
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(found)), size)
    v = np.frombuffer(b"".join(own[s:e] for own, s, e, _ in found), np.uint8)
    low = np.where((v >= 65) & (v <= 90), v + 32, v).astype(np.uint8)
    kind = _KIND[v]
    share = lambda mask: np.add.reduceat(mask.astype(np.int64), first) / size
    key, count = np.unique(of * 256 + v, return_counts=True)
    p = count / size[key // 256]
    entropy = np.bincount(key // 256, -p * np.log2(p), len(found))
    inner = np.flatnonzero(of[1:] == of[:-1])
    changes = np.bincount(of[inner], kind[inner + 1] != kind[inner], len(found))
    letter = (low >= 97) & (low <= 122)
    pair = inner[letter[inner] & letter[inner + 1]]
    bits = np.bincount(of[pair], model["pairs"][low[pair].astype(np.int64) - 97, low[pair + 1].astype(np.int64) - 97], len(found))
    letters = np.bincount(of[pair], minlength=len(found))
    last = first[of] + size[of]
    cover = np.zeros(len(v) + 1, np.int64)
    for n, hashes in model["windows"].items():
        at = np.flatnonzero(np.arange(len(v)) + n <= last)
        h = span_hashes(low, at, at + n)
        hit = at[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + n, -1)
    rows = []
    for own, s, e, path in found:
        before, after = own[max(0, s - 40) : s].decode("utf-8", "ignore"), own[e : e + 24].decode("utf-8", "ignore")
        word, where = own[s:e].decode("ascii", "ignore").lower(), (path or "").lower()
        rows.append((
            word.count("@"), word.count("."), word.count("/"), KEYWORDS.search(before) is not None, before.rstrip(" \"'")[-1:] in ("=", ":"), before[-1:] in ("\"", "'", "`"),
            EXAMPLES.search(word) is not None or EXAMPLES.search(before + " " + after) is not None, before[-2:-1] == ")" or "+" in before[-8:], re.search(r"test|example|doc|sample", where) is not None, where.count("/"),
            KNOWN_IN.match(own, s, e) is not None, PRIVATE.match(own, s, e) is not None, DIGESTS.search(before) is not None, DIGEST_IN.match(own, s, e) is not None,
        ))
    hexes = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 102))
    numeric = [size, *(share(kind == k) for k in (1, 2, 3, 0)), share(hexes), entropy, changes / size, bits / np.maximum(letters, 1), share(np.cumsum(cover[:-1]) > 0)]
    return np.column_stack([*numeric, np.array(rows, float)])


def dictionary(docs: DataFrame) -> dict:
    """{"words", "windows", "pairs"} of all documents: the most frequent words, their hashes by length, and the bits of a letter after another."""
    each = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("length(w) >= 2")
    words = cut(each.groupBy("w").agg(F.count("*").alias("n")))
    # only words of counts that can be among the first are sorted: a bound from how many words have about which count
    level = F.floor(8 * F.log2("n"))
    least, so_far = 0, 0
    for r in sorted(words.groupBy(level.alias("k")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["k"]):
        least, so_far = r["k"], so_far + r["m"]
        if so_far >= DICTIONARY_WORDS:
            break
    top = words.where(level >= least).orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS).collect()
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    first = F.sum("n").over(W.partitionBy(F.substring("p", 1, 1)))
    # values have ASCII letters only: no other pair is looked up, but all count in the totals of their first letter
    bits = pairs.where("p rlike '^[a-z]'").withColumn("all", first).where("p rlike '^[a-z]{2}$'").collect()
    table = np.full((26, 26), 14.0)
    for r in bits:
        table[ord(r["p"][0]) - 97, ord(r["p"][1]) - 97] = -np.log2(r["n"] / r["all"])
    known = {r["w"] for r in top if len(r["w"]) >= 3}
    return {"words": known, "windows": _windows(sorted(w.encode() for w in known if w.isascii() and len(w) <= 12)), "pairs": table}


def split(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The findings to learn from, and the fifth that is held out, by a hash of the finding."""
    out = [hashlib.md5(own + b"%d" % s).digest()[0] % 5 == 0 for own, s, *_ in rows]
    return [r for r, o in zip(rows, out, strict=True) if not o], [r for r, o in zip(rows, out, strict=True) if o]


def _judged(forest: Forest, rows: list[tuple], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """What the forest says of labelled findings, and what they are."""
    return forest.predict(featurise([r[:4] for r in rows], model)) >= LEVEL, np.array([r[4] for r in rows], bool)


def _learnt(rows: list[tuple], model: dict) -> Forest:
    return Forest().fit(featurise([r[:4] for r in rows], model), np.array([r[4] for r in rows], float))


def _by_kind(said: np.ndarray, true: np.ndarray, kinds: list[str]) -> dict[str, tuple[int, int, float]]:
    """{kind: (label, number of findings, share of them judged rightly)}"""
    names, right = np.array(kinds, object), said == true
    return {k: (int(true[names == k][0]), int((names == k).sum()), float(right[names == k].mean())) for k in sorted(set(kinds))}


def fit(docs: DataFrame, labelled: list[tuple] | None = None) -> dict:
    """The model: forest, dictionary, letter pairs, and precision and recall on the held-out fifth (None without any).

    labelled: findings that were reviewed, with or without the name of a kind behind the label; else secrets and
    look-alikes planted in the documents' texts. by_kind has the share judged rightly of each named kind held out.
    """
    model = dictionary(docs)
    rows, held = split(labelled if labelled is not None else planted.findings(docs, candidates, FINDINGS))
    model["forest"] = _learnt(rows, model)
    said, true = _judged(model["forest"], held, model)
    hits = int((said & true).sum())
    named = [len(r) > 5 for r in held]
    by_kind = _by_kind(said[named], true[named], [r[5] for r in held if len(r) > 5])
    return model | {"precision": hits / said.sum() if said.any() else None, "recall": hits / true.sum() if true.any() else None, "by_kind": by_kind}


def unseen_kinds(docs: DataFrame, labelled: list[tuple] | None = None, only: list[str] | None = None) -> dict[str, tuple[int, int, float]]:
    """{kind: (label, number of findings, share judged rightly)} where the forest learns from all other kinds alone.

    labelled as for fit, each with the name of its kind. only: these kinds in turn (all, if None). It says what to
    expect of kinds that no reviewed finding shows.
    """
    model = dictionary(docs)
    rows = labelled if labelled is not None else planted.findings(docs, candidates, FINDINGS)
    out = {}
    for kind in sorted({r[5] for r in rows} if only is None else only):
        own = [r for r in rows if r[5] == kind]
        if own:
            out |= _by_kind(*_judged(_learnt([r for r in rows if r[5] != kind], model), own, model), [kind] * len(own))
    return out


def scan_texts(texts: list[str | None], paths: list[str | None], model: dict) -> list[tuple[int, bytes, int, int, float]]:
    """The candidates that the forest takes for secrets: (index of text, its bytes, start, end, score)."""
    found = candidates(texts)
    if not found:
        return []
    p = model["forest"].predict(featurise([(own, s, e, paths[i]) for i, own, s, e in found], model))
    return [(*c, float(q)) for c, q in zip(found, p, strict=True) if q >= LEVEL]


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, start, length, score, secret_sha256): a row for each secret; start counts code points of the text."""
    ddl = "doc_id long, start long, length long, score double, secret_sha256 string"
    schema, shared = arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows, at = [], (-1, 0, 0)  # text, bytes and code points so far
            for i, own, s, e, q in scan_texts(b.column(1).to_pylist(), b.column(2).to_pylist(), shared.value):
                _, done, chars = at if at[0] == i else (i, 0, 0)
                at = (i, s, chars + len(own[done:s].decode("utf-8", "surrogatepass")))
                rows.append((ids[i], at[2], len(own[s:e].decode("utf-8", "surrogatepass")), q, hashlib.sha256(own[s:e]).hexdigest()))
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text", "source").mapInArrow(run, ddl)


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """docs with MASK in the place of each secret; all columns and rows stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, shared = to_arrow_schema(docs.schema), docs.sparkSession.sparkContext.broadcast(model)
    at, path = docs.columns.index("text"), docs.columns.index("source")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            gone: dict[int, list] = {}
            for i, own, s, e, _ in scan_texts(texts, b.column(path).to_pylist(), shared.value):
                gone.setdefault(i, [own]).append((s, e))
            for i, (own, *spans) in gone.items():
                kept = [own[x:y] for (_, x), (y, _) in zip([(0, 0), *spans], [*spans, (len(own), 0)], strict=True)]
                texts[i] = MASK.encode().join(kept).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(texts, schema.field(k).type) if k == at else c.cast(schema.field(k).type) for k, c in enumerate(b.columns)], schema=schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return scan(docs, fit(docs))
