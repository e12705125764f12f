"""Each operator against a brute-force version, a library or an exact round trip, on small and odd inputs."""

import functools
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from podium.llm import backoff, bpe, common, ctph, flac, language, lines, nearjoin, packing, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, h long"
RND = random.Random(3)
WORDS = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "while", "rain", "falls", "on", "quiet", "hills", "and", "rivers"]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = prose(120)
ODD = [
    (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", "s2"), (4, "Hi", "en", None), (5, BASE, "en", "s1"), (6, BASE, "en", "s2"), (7, BASE + " extra words here", "en", "s3"),
    (8, prose(80), "en", "s1"), (8, prose(80), "en", "s1"), (9, "x" * 5000, "en", "s4"), (10, "naïve café ÉTÉ 日本語 🙂 <|endoftext|>", "fr", "s5"), (None, "a lone row without an id at all", "en", "s6"),
    (11, "the same four words", "en", "s1"), (12, "The SAME four words", "en", "s2"), (13, prose(4000), "en", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "p", 1) for i, t, g, s in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- shared helpers


def test_span_hashes_do_not_depend_on_place():
    a, b = np.frombuffer(b"xxabcxx", np.uint8), np.frombuffer(b"abc", np.uint8)
    assert common.span_hashes(a, np.array([2]), np.array([5]))[0] == common.span_hashes(b, np.array([0]), np.array([3]))[0]


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long")), "node", "comp"))
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[202] == 200 and len(got) == 41 + 30 + 3
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 secrets


def test_secrets_are_found_and_placeholders_left(spark):
    rnd = random.Random(5)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    true, texts = [], []
    for i in range(60):
        s = hexes(40)
        true.append(s)
        texts.append(f'{prose(30)} token = "{s}" {prose(20)}' if i % 2 else f"{prose(30)} call +1 (555) 201-4455-{i} or 41{rnd.randint(10**13, 10**14)} {prose(5)} mail{i}.user@host.example.com password={s} {prose(9)}")
    false = ['token = "changeme-please-now" and password=xxxxxxxxxxxxxxxxxxxx', "order 4111-1111-1111-1111 shipped"]
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate([*texts, *false, None, ""])], "doc_id long, text string, lang string, source string")
    model = secrets.fit(d)
    found = secrets.scan(d, model).collect()
    want = {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in enumerate(true)}
    assert {(r["doc_id"], r["secret_sha256"]) for r in found} == want
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == true[r["doc_id"]]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(d, model).collect()}
    assert all(secrets.MASK in clean[i] and true[i] not in clean[i] for i in range(60)) and clean[60] == false[0] and clean[62] is None


def test_secrets_on_odd_rows(spark, docs, empty):
    model = secrets.fit(docs)
    assert secrets.scan(docs, model).count() == 0 and secrets.redact(docs, model).count() == len(ODD) and secrets.redact(docs, model).columns == docs.columns
    assert secrets.scan(empty, secrets.fit(empty)).count() == 0


# -- 2 quality


def test_quality_ranks_held_out_documents(spark):
    rnd = random.Random(9)
    good = lambda: ". ".join(prose(8, rnd).capitalize() for _ in range(10))
    bad = lambda: " ".join([rnd.choice(WORDS)] * 40) if rnd.random() < 0.5 else prose(40, rnd).upper().replace(" ", "!! ")
    data = [(i, good() if i % 5 else bad(), int(i % 5 > 0)) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score(d, quality.fit(spark, d, labels)).collect()
    truth = {i: q for i, _, q in data}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.97 and all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in got)


def test_quality_on_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(spark, docs, none)).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0.5 for r in got)
    assert quality.score(empty, quality.fit(spark, empty, none)).count() == 0
    assert (quality.features([None, "", " \n"]) == 0).all()
    assert np.allclose(quality.features([BASE, "x y"])[0], quality.features(["other text first", BASE])[1])


def test_quality_fit_equals_newton_over_all_pairs(spark):
    rnd = random.Random(21)
    noisy = lambda bad: " ".join(w.upper() if rnd.random() < 0.2 + 0.2 * bad else w + rnd.choice([".", ",", "1", "|", "\n", "é", ""]) for w in prose(rnd.randint(3, 40), rnd).split())
    data = [(i, noisy(i % 3 == 0), int(i % 3 > 0) if rnd.random() < 0.8 else int(i % 3 == 0)) for i in range(500)]
    train = [(t, q) for i, t, q in data if zlib.crc32(str(i).encode()) % 5]
    labels = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, _, q in data]  # labels held out say the reverse
    d = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, "no id"), (777, "no label")], "doc_id long, text string").repartition(5)
    got = quality.fit(spark, d, spark.createDataFrame([*labels, *((i, 1) for i, _ in labels), (9999, 0), (3, None)], "doc_id long, quality int"))
    x, q = quality.features([t for t, _ in train]), np.array([q for _, q in train])
    diff = (x[q == 1][:, None] - x[q == 0][None]).reshape(-1, x.shape[1])
    scale = np.sqrt((diff**2).mean(axis=0))
    scale[scale == 0] = 1
    diff, w = diff / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(diff @ w))
        w = w - np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(len(w)), 1e-3 * w - p @ diff / len(diff))
    assert np.abs(got["w"] * scale - w).max() < 1e-7 * np.abs(w).max()
    s = np.sort(x @ (w / scale))
    zeros = int((q == 0).sum())
    assert abs(got["tau"] - s[zeros - 1 : zeros + 1].mean()) < 1e-6


def test_quality_fit_has_every_labelled_document(spark):
    n = 12000  # more than 4000 of each class
    ids = [i for i in range(n * 5 // 4 + 200) if zlib.crc32(str(i).encode()) % 5][:n]
    d = spark.createDataFrame([(i, "a " * (k // 30 + 1) + "B" * (k % 2) + "!" * (k % 30)) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k % 2 == 0 or k % 7 == 0)) for k, i in enumerate(ids)], "doc_id long, quality int")
    got = quality.score(d, quality.fit(spark, d, labels))
    zeros = sum(not (k % 2 == 0 or k % 7 == 0) for k in range(n))
    scores = [r["score"] for r in got.orderBy("score").collect()]
    assert scores[zeros - 1] <= 0.3 + 1e-12 and scores[zeros] >= 0.3 - 1e-12
    assert abs(sum(math.log(p / (1 - p)) for p in scores[zeros - 1 : zeros + 1]) / 2 - math.log(0.3 / 0.7)) < 1e-9


# -- 3 language


def ppm_bits(counts, text):
    """Code length by the definition: dictionaries of counts by context, from the longest down."""
    s = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b"\0", text.lower().encode())
    s, total = b"\0\0\0" + s, 0.0
    for i in range(3, len(s)):
        for k in (3, 2, 1, 0):
            c = counts[k].get(s[i - k : i], {})
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                total -= math.log2(c[s[i]] / (n + d))
                break
            if n:
                total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_language_code_lengths_are_exact(spark):
    train = {"aa": ["the rain falls on hills", "quiet rivers and rain; the end."], "bb": ["der regen fällt auf hügel", "stille flüsse und regen. über"]}
    d = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate((g, t) for g, ts in train.items() for t in ts)], "doc_id long, lang string, text string")
    g = language.count_grams(d).toPandas().sort_values(["lang", "gram"])
    trees = language.Trees(g["lang"].to_numpy(object), g["gram"].to_numpy(np.int64), g["n"].to_numpy(float))
    texts = ["The rain, and über hills", "flüsse", "zzz qqq", "a", *train["aa"], None, "", "1234 !!"]
    bits, _ = trees.bits(texts)
    for j, lang in enumerate(trees.langs):
        counts = [{} for _ in range(4)]
        for t in train[lang]:
            s = b"\0\0\0" + re.sub(rb"[\x00-\x60\x7b-\x7f]+", b"\0", t.lower().encode())
            for i in range(3, len(s)):
                for k in range(4):
                    counts[k].setdefault(s[i - k : i], Counter())[s[i]] += 1
        for t, b in zip(texts[:6], bits[:6, j], strict=True):
            assert b == pytest.approx(ppm_bits(counts, t), rel=1e-5), (lang, t)
    lang, score, _ = language.decide(trees, texts)
    assert lang[1] == "bb" and lang[4] == "aa" and lang[-3:] == ["und"] * 3 and score[-1] == 0


def test_language_on_odd_rows(docs, empty):
    trees = language.fit(docs)
    got = language.predict(docs, trees).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    kept = language.keep_known(docs, trees)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()} and {5, 8} <= {r["doc_id"] for r in kept.collect()}
    assert language.predict(empty, language.fit(empty)).count() == 0


# -- 4 fingerprints


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_edit_distances():
    r = random.Random(2)
    a, b = ([("".join(r.choice("ABCz9+/") for _ in range(r.randint(0, 64)))) for _ in range(200)] for _ in range(2))
    assert ctph.distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def test_fingerprints_compare_edited_texts(docs, empty):
    got = ctph.compared(docs).collect()
    of_text = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(ODD, key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), -of_text[x[1]]))
    texts = [x[1] or "" for x in order]
    want = Counter()
    for k, t in enumerate(texts):
        u = texts[(k + 1) % len(texts)]
        want[order[k][0], hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    alike = {r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}
    assert len(alike) == 1 and ctph.compared(empty).count() == 0
    one, two = ctph.fingerprints([BASE, BASE.replace("fox", "cat", 1)])
    assert ctph.likeness([one], [two])[0] > 0.7 and ctph.fingerprints(["junk " * 9, BASE])[1] == one and ctph.fingerprints([None]) == ["0::"]


def plain_fingerprint(text):
    """By the definition, a byte at a time."""
    data = text.encode("utf-8", "surrogatepass")
    ends = []  # (end of a piece, largest k at which it ends)
    for i in range(len(data)):
        h = sum(int(ctph._BYTE[data[i - j]]) * pow(0x9E3779B1, j, 2**32) for j in range(ctph.WINDOW) if i >= j) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h = (h ^ h >> 13) + 1
        if h % 3 == 0:
            m = h // 3
            ends.append((i + 1, (m & -m).bit_length() - 1))
    k = max(0, math.ceil(math.log2(max(len(data), 1) / (3 * ctph.SIGNATURE))))
    while k and sum(level >= k for _, level in ends) < ctph.SIGNATURE // 2:
        k -= 1

    def signature(k):
        cuts = [e for e, level in ends if level >= k][: ctph.SIGNATURE - 1]
        cuts += [len(data)] if data and (not cuts or cuts[-1] < len(data)) else []
        pieces = [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return "".join(chr(ctph.LETTERS[int(common.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) >> 58]) for x in pieces)

    return f"{k}:{signature(k)}:{signature(k + 1)}"


def test_fingerprints_by_their_definition():
    texts = [t for _, t, *_ in ODD if t and len(t) < 6000] + ["", "a", prose(700), "ab" * 900]
    assert ctph.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_an_id_that_most_rows_have_is_split(spark):
    rows_of = [(7 if k % 3 else k, f"{prose(3)} {k}") for k in range(300)] + [(None, f"n {k}") for k in range(100)]
    d = spark.createDataFrame(rows_of, "doc_id long, text string").repartition(5)
    of_text = {r["text"]: r["h"] for r in d.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows_of, key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), -of_text[x[1]]))
    want = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in ctph.compared(d).collect()) == want
    assert max(r["count"] for r in ctph.in_order(d, 300).groupBy("bucket").count().collect()) < 60


TABLES = "/root/testdata/sf0.1"
on_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@on_tables
def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").where("quality is not null").collect()}
    got = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in quality.query(spark, TABLES).collect() if r["held_out"] and r["doc_id"] in labels]
    score, label, said = (np.array(x) for x in zip(*got, strict=True))
    rank, ones = np.argsort(np.argsort(score)), int(label.sum())
    assert (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones)) > 0.99 and (said == label).mean() > 0.97


@on_tables
def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").where("lang is not null").select("doc_id", "lang").collect()}
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in language.query(spark, TABLES).collect() if r["held_out"] and r["doc_id"] in langs]
    assert len(right) > 1000 and np.mean(right) > 0.99


# -- 5 lines


CLASHES = ["__id", "__t", "__h", "__n", "__at", "__gone", "__first", "__lines", "__removed", "i", "t", "one", "many", "n", "comp", "rep", "key", "hash", "bucket", "borrowed", "at", "w", "p", "chunk", "known", "label", "x"]


def test_columns_of_any_name_stay_as_they_are(spark, tmp_path):
    """Every stage that returns documents, over columns that have the names the operators use inside, and over no rows."""
    import corpus_pipeline

    texts = ["\n".join(["a line that all the sites have", prose(40, random.Random(k % 20))]) for k in range(60)]
    data = [(k, t, "en", f"s{k % 7}", len(t), *(1000 * k + j for j in range(len(CLASHES)))) for k, t in enumerate(texts)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES)).repartition(3)
    own = {r[0]: r[5:] for r in data}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} <= set(own)
        else:
            assert out.columns == d.columns and all(tuple(r[5:]) == own[r["doc_id"]] for r in out.collect()) and out.count() in (20, 60)
        none = stage(spark, d.where("false"), str(tmp_path))
        assert none.count() == 0 and (name == "packing" or none.columns == d.columns)
    assert corpus_pipeline.STAGES[2][1](spark, d, str(tmp_path)).count() == 20



def test_lines_against_brute_force(spark, docs, empty):
    r = random.Random(4)
    pool = [prose(6, r) for _ in range(12)]
    data = [(i, None if i == 7 else "\n".join(r.choice(pool) if r.random() < 0.6 else f"{prose(5, r)} {i}" for _ in range(r.randint(0, 9))), r.choice(["a", "b", "c", "d", "e", "f", None])) for i in range(60)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    sites, first = {}, {}
    for i, t, s in data:
        for k, line in enumerate((t or "").split("\n")):
            if len(line.strip(" ")) >= lines.MIN_CHARS:
                sites.setdefault(line.strip(" "), set()).add(s)
                first.setdefault(line.strip(" "), (i, k))
    spread = {x for x, s in sites.items() if len(s - {None}) >= 4}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if x.strip(" ") not in spread or first[x.strip(" ")] == (i, k)) for i, t, _ in data}
    got = lines.clean(d, 4)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and spread
    assert lines.clean(docs).count() == len(ODD) and lines.without_boilerplate(docs).columns == docs.columns and lines.clean(empty).count() == 0


def test_boilerplate_by_shuffle_or_broadcast(spark):
    texts = ["\n".join(["one line on every site", f"own line number {k} of this text", "one line on every site"]) for k in range(40)]
    d = spark.createDataFrame([(k, t, f"s{k % 8}") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    a, b = (rows(lines.clean(d, broadcast=n, counts=("n", "gone")), "doc_id", "text", "n", "gone") for n in (0, 10**6))
    assert a == b and a[0][1].count("one line") == 1 and all("one line" not in x[1] for x in a[1:]) and a[1][2:] == (3, 2)


# -- 6 near duplicates


def brute_components(data):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(data)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(data)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(data):
        least.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(data)]


@pytest.mark.parametrize("family", [nearjoin.FAMILY, 400])
def test_near_duplicates_against_brute_force(spark, family):
    r = random.Random(11)
    data = [(i, prose(r.randint(0, 60), r)) for i in range(60)]
    shared = prose(60, r)
    data += [(100 + i, shared + " " + prose(r.randint(5, 80), r)) for i in range(25)]
    for g in range(4):
        w = [f"{x}{g}" for x in prose(90, r).split()]
        for i in range(14):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = f"z{r.randrange(99)}"
            data.append((200 + 20 * g + i, " ".join(v).upper() if i % 3 else " ".join(v)))
    data += [(300, None), (301, ""), (None, data[70][1]), (303, "one two"), (304, "ONE  two"), (5, data[5][1])]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = nearjoin.components_of(d, family)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(data), key=repr)


def test_switches_by_size_change_no_component(spark, monkeypatch):
    """Both sides of each bound: families split into blocks, taken apart by finer points or not, members joined by a shuffle."""
    r = random.Random(12)
    shared = prose(70, r)
    data = [(k, shared + " " + prose(r.randint(2, 12), r)) for k in range(30)] + [(100 + k, prose(50, r)) for k in range(20)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = sorted(brute_components(data), key=repr)
    refined = nearjoin.refined
    for family, most, members in ((400, 10**6, 0), (400, 0, 0), (10**9, 10**6, 10**6)):
        monkeypatch.setattr(nearjoin, "refined", functools.partial(refined, most=most))
        monkeypatch.setattr(nearjoin, "BROADCAST_MEMBERS", members)
        assert rows(nearjoin.components_of(d, family), "doc_id", "n_shingles", "component_id") == want


def test_runs_too_long_to_compare_come_in_pieces(monkeypatch):
    monkeypatch.setattr(nearjoin, "RUN", 3)
    keys, values = [1, 1, 2, 2, 2, 2, 2, 2, 2, 3], list(range(10))
    batches = [pa.record_batch([pa.array(keys[a:b], pa.int64()), pa.array(values[a:b], pa.int64())], ["k", "v"]) for a, b in ((0, 4), (4, 5), (5, 10))]
    got = [(h[0][0], h[1], begins, ends) for h, begins, ends in nearjoin._runs(batches, 2)]
    assert got == [(1, [0, 1], True, True), (2, [2, 3, 4], True, False), (2, [5, 6, 7], False, False), (2, [8], False, True), (3, [9], True, True)]


def test_rows_without_an_id_do_not_meet_each_other(spark):
    """Each class finds its own text, however many rows share the id."""
    texts = [prose(30, random.Random(k % 25)) for k in range(100)]
    d = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    classes = nearjoin.profiled(d, 16).where("block is null").groupBy("h").agg(F.min(F.struct(nearjoin._id().alias("i"), "t")).alias("rep"))
    got = nearjoin.with_text(classes, d)
    assert got.count() == 100 and got.select("h").distinct().count() == 25
    assert nearjoin.one_of_each(d).count() == 25


def test_near_duplicates_on_odd_rows(docs, empty):
    assert rows(nearjoin.components_of(docs), "doc_id", "n_shingles", "component_id") == sorted(brute_components([(i, t) for i, t, *_ in ODD]), key=repr)
    kept = nearjoin.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 8, 8, 9, 10, None, 11, 13])
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id is not null").withColumn("doc_id", F.lit(None).cast("long")))
    assert Counter(r["doc_id"] for r in nearjoin.one_of_each(twice).collect()) == Counter([1, 1, 2, 2, 3, 3, 4, 5, 8, 8, 9, 10, None, 11, 13] + [None] * 3)
    assert nearjoin.components_of(empty).count() == 0


# -- 7 language model


def plain_backoff(texts, order):
    """(events, mean score) of each text, gram by gram."""
    seqs = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        seqs.append(["<", *w, ">"] if w else [])
    n = Counter(tuple(s[i - k + 1 : i + 1]) for s in seqs for i in range(len(s)) for k in range(1, order + 1) if k <= i + 1)
    total = sum(len(s) - 1 for s in seqs if s)

    def score(gram):
        if len(gram) == 1:
            return math.log(n[gram] / total)
        return math.log(n[gram] / n[gram[:-1]]) if n[gram] >= 2 else math.log(0.4) + score(gram[1:])

    out = []
    for s in seqs:
        v = [score(tuple(s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s))]
        out.append((len(v), round(sum(v) / len(v), 9) if v else None))
    return out


@pytest.mark.parametrize(("order", "part_chars", "chunk_chars"), [(2, backoff.PART_CHARS, backoff.CHUNK), (2, 300, 900), (3, 2000, 100), (4, 500, 10**6)])
def test_backoff_against_brute_force(docs, order, part_chars, chunk_chars):
    """Up to about 130 parts, and chunks of a document or of all."""
    want = [(i, *v) for (i, *_), v in zip(ODD, plain_backoff([t for _, t, *_ in ODD], order), strict=True)]
    got = [(r["doc_id"], r["n_events"], None if r["score"] is None else round(r["score"], 9)) for r in backoff.scores(docs, order, part_chars, chunk_chars).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_backoff_of_a_pair_that_most_documents_share(spark):
    texts = ["same pair " * 30 + prose(5, random.Random(k)) for k in range(120)] + [None, "", "same"]
    d = spark.createDataFrame([(k % 100, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, part string").repartition(7)
    got = [(r["doc_id"], r["n_events"], None if r["score"] is None else round(r["score"], 9)) for r in backoff.scores(d, part_chars=400, chunk_chars=700).collect()]
    assert sorted(got, key=repr) == sorted([(k % 100, *v) for k, v in enumerate(plain_backoff(texts, 2))], key=repr)
    rows_of = backoff.joined(backoff.exploded(d, 50, chunk_chars=700)).groupBy("part").count().where("part >= 0").collect()
    chunks = d.count()
    assert len(rows_of) <= 50 and max(r["count"] for r in rows_of) <= chunks  # a frequent pair is an entry a chunk


def test_backoff_of_nothing(empty):
    assert backoff.scores(empty).count() == 0


# -- 8 byte-pair encoding


def odd_texts():
    r = random.Random(1)
    return [*(t for _, t, *_ in ODD), "a\x1c\x1d b\x85\xa0 c d　", "it's we'll I'D 12345 ½²", "  \n\n a  b\t", *("".join(r.choice("abcdefgh eht inoasr\n'é日🙂012.,!ÉÀß") for _ in range(200)) for _ in range(200))]


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.vocabulary_file()), bpe.Vocabulary(open(bpe.vocabulary_file(), encoding="utf-8").read())
    texts = odd_texts()
    for t, e in zip(texts, own.encode_all(texts), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(e, "<u4").tolist() == ids and own.decode(e) == lib.decode(ids, skip_special_tokens=False)
    words = [w.encode() for w in ("onatst", "Eauouon", "x" * 100, "é", "thing")]
    assert own.merge_many(words) == [own.merge(w) for w in words]
    assert bpe.digests(docs).count() == len(ODD) and bpe.digests(empty).count() == 0


# -- 9 packing


def test_packing_covers_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_file("word_bpe_49k.json"))
    got = packing.pack(common.checkpoint(packing.pieces(docs, with_ids=True)), group=8).collect()
    seen = Counter()
    for _, ps in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for p in ps:
            assert p["offset"] == at and zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
            at += p["length"]
        assert 0 < at <= packing.WINDOW
    for i, t, *_ in ODD:
        seen[i] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == seen and packing.packed(empty).count() == 0


def test_best_fit_is_tight_and_equals_a_plain_search():
    r = random.Random(6)
    sizes = [r.randint(1, 64) for _ in range(500)]
    which, offset = packing.best_fit(sizes, 64)
    free, at = [], {}
    for i in sorted(range(500), key=lambda k: -sizes[k]):
        fits = [f for f in free if f >= sizes[i]]
        left = (min(fits) if fits else 64) - sizes[i]
        if fits:
            free.remove(min(fits))
        free += [left] if left else []
        at[i] = left
    assert sorted(64 - o - s for o, s in zip(offset, sizes, strict=True)) == sorted(at.values())
    assert len(set(which)) <= sum(sizes) / 64 * 1.02 + 1


# -- 10 media


def test_flac_round_trips_and_checks():
    r = np.random.default_rng(0)
    payloads = [flac.payload(t) for t in odd_texts()] + [r.integers(0, 256, 192 * 7, dtype=np.uint8).tobytes(), bytes(192), bytes([0] * 191 + [255]), bytes([0, 255] * 960)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads and flac.encode(payloads[3:5]) == streams[3:5]
    assert flac.decode(flac.encode(payloads, linear=([120, -60], 6))) == payloads == flac.decode(flac.encode(payloads, linear=False))
    kinds = lambda s: {s[i["frames"] + int(o) + 6] >> 1 & 63 for i in [flac.stream_info(s)] for o in i["points"]["o"][i["points"]["n"] == flac.BLOCK]} | {0}
    assert max(map(max, map(kinds, streams))) == 31 + flac.LINEAR and max(map(max, map(kinds, flac.encode(payloads, linear=False)))) < 13
    assert sum(map(len, streams)) < sum(map(len, flac.encode(payloads, linear=False)))
    long = max(range(len(payloads)), key=lambda k: len(payloads[k]))
    assert flac.read_from(streams[long], 3000, 700) == payloads[long][3000:3700]
    s = streams[long]
    at = s.index(b"fLaC") + 4
    size = int.from_bytes(s[at + 1 : at + 4], "big")
    bare = s[:4] + bytes([0x80]) + s[at + 1 : at + 4 + size] + s[flac.stream_info(s)["frames"] :]
    assert flac.decode([bare]) == [payloads[long]]  # without a seek table
    broken = bytearray(s)
    broken[-40] ^= 1
    with pytest.raises(flac.Corrupt):
        flac.decode([bytes(broken)])


def test_flac_of_another_encoder():
    """The 8-bit example stream of RFC 9639: a linear predictor of order 3, one Rice partition, a block size of its own; its MD5 is checked."""
    stream = bytes.fromhex("664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3")
    assert [x - 128 for x in flac.decode([stream])[0]] == [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]


def test_a_corrupt_stream_is_a_row_with_its_status(spark):
    texts = [prose(300 + k) for k in range(6)]
    streams = flac.encode([flac.payload(t) for t in texts])
    streams[1], streams[3], streams[4] = streams[1][:-60] + b"?" + streams[1][-59:], streams[3][:700], b"no stream"
    stored = spark.createDataFrame([(k, len(t), bytearray(m)) for k, (t, m) in enumerate(zip(texts, streams, strict=True))], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in flac.digests(stored).collect()}
    assert {k for k, r in got.items() if r["status"] == "ok"} == {0, 2, 5} and all(got[k]["status"].startswith("corrupt") and got[k]["payload_sha256"] is None for k in (1, 3, 4))
    assert all(got[k]["payload_sha256"] == hashlib.sha256(flac.payload(texts[k])).hexdigest() for k in (0, 2, 5))
    assert {r["doc_id"] for r in flac.pcm_blocks(stored).collect()} == {0, 2, 5}
    blocks = flac.blocks_of(streams[:1], 500)[0]
    assert flac.samples_at(blocks, 480, 600) == flac.payload(texts[0])[480:1080] and flac.samples_at(blocks, 0, 10**6) == flac.payload(texts[0])


def test_media_columns(docs, empty):
    stored = flac.media(docs)
    got = {r["doc_id"]: r for r in flac.digests(stored).collect()}
    for i, t, *_ in ODD:
        if i not in (8, None):
            p = flac.payload(t)
            assert got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(p[-16:]) and got[i]["payload_bytes"] == len(p) and got[i]["n_bytes"] == len((t or "").encode())
    blocks = sorted((r["sample_offset"], bytes(r["pcm"])) for r in flac.pcm_blocks(stored, 1000).where("doc_id = 13").collect())
    assert b"".join(b for _, b in blocks) == flac.payload(ODD[-1][1]) and got[5]["media_sha256"] == got[6]["media_sha256"]
    assert flac.digests(flac.media(empty)).count() == 0


# -- pipeline


def test_pipeline_keeps_and_drops_what_it_should(spark, docs, tmp_path):
    import corpus_pipeline

    d, at = docs, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, d = d, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert d.columns == before.columns
        if name == "near_duplicates":
            at = {r["doc_id"] for r in d.collect()}
    assert {5, 8, 13} <= at and not {1, 2, 3, 6} & at and {r["doc_id"] for r in d.collect()} == at


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(21)
    common_line, data = "all rights reserved by the quiet hills", []
    for i in range(70):
        body = [prose(r.randint(8, 20), r) for _ in range(r.randint(2, 6))]
        if i % 3 == 0:
            body.insert(r.randint(0, len(body)), common_line)
        if i % 4 == 0:
            body.append(f'{prose(6, r)} token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" {prose(4, r)}')
        data.append((i, "\n".join(body), f"s{i % 8}"))
    data += [(100 + i, data[5 * i][1] + " and more", f"s{i}") for i in range(8)] + [(200, None, "s1"), (201, "123 456", "s2"), (202, common_line, "s3")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t, s) for i, t, s in data if t and re.search("[a-z]", t)]
    sites, first = {}, {}
    for i, t, s in kept:
        for k, line in enumerate(t.split("\n")):
            sites.setdefault(line, set()).add(s)
            first.setdefault(line, (i, k))
    gone = {x for x, v in sites.items() if len(v) >= lines.MIN_SITES and len(x) >= lines.MIN_CHARS}
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if x not in gone or first[x] == (i, k))) for i, t, _ in kept]
    kept = [(i, t) for i, t in kept if t.strip()]
    parts = brute_components(kept)
    kept = [(i, t) for (i, t), (_, n, c) in zip(kept, parts, strict=True) if n == 0 or c == i]
    kept = [(i, re.sub('token = "[0-9a-f]{40}"', f'token = "{secrets.MASK}"', t)) for i, t in kept]
    lib = Tokenizer.from_file(bpe.vocabulary_file("word_bpe_49k.json"))
    assert gone == {common_line} and len(kept) < len(data) - 8
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept}
    assert {p["doc_id"]: p["doc_tokens"] for p in got} == want and sum(p["length"] for p in got) == sum(want.values())


def test_signs_that_are_no_letters_have_no_language(spark):
    """Numerals and marks are not letters, as str.isalpha has it."""
    texts = ["²", "½ ①", "Ⅷ 12", "...", "é", "日", "ª"]
    trees = language.fit(spark.createDataFrame([(i, prose(50), "en", "s", 1, "p", 1) for i in range(40)], SCHEMA))
    assert [x == "und" for x in language.decide(trees, texts)[0]] == [not any(c.isalpha() for c in t) for t in texts] == [True] * 4 + [False] * 3


def test_one_id_with_two_texts_keeps_a_spread_line_once(spark):
    line = "this line stands everywhere"
    rows = [(1, f"{line}\nfirst text of one", None, f"s{k}", 1, "p", 1) if k < 1 else (1, f"{line}\nsecond text of one", None, "s1", 1, "p", 1) if k == 1 else (k, f"{line}\nown words {k}", None, f"s{k}", 1, "p", 1) for k in range(7)]
    out = lines.clean(spark.createDataFrame(rows, SCHEMA))
    assert sum(line in r["text"] for r in out.collect()) == 1
