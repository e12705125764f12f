"""Mixing sources against a plain version, and its odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from podium.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, src int, NTH string, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], SCHEMA).repartition(3)


def some(n=300, seed=5):
    rnd = random.Random(seed)
    sources = ["a", "b", "b", "b", "b", "c", "é", None, "tiny"]
    rows = [(i, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.choice([0, 1, 3, 9, 40, 200]))), rnd.choice(sources[:8])) for i in range(n)]
    return [*rows, (None, "no id", "a"), (7, "again", "b"), (7, "again", "b"), (8, None, "b"), (9, " \n\t", "c"), (1000, "one", "tiny"), (1001, "", "void")]


def plain_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(size.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        more = {s for s in free if weight[s] * level >= 3 * size[s]}
        if not more:
            return size, {s: 3.0 * size[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def taken(spark, rows, block, shard):
    size = mixing.sized(table(spark, rows))
    of = mixing.targets(size, block)
    plan = mixing.plan(of, block, shard)
    takes = plan.groupBy("src", "block").agg(F.collect_list("take").alias("takes"))
    return of, plan, mixing.pieces(mixing.placed(size, of), block).join(takes, ["src", "block"], "left")


@pytest.mark.parametrize("block, shard", [(4, 8), (16, 1000), (2048, 1024)])
def test_targets_are_met_and_no_document_is_overused(spark, block, shard):
    rows = some()
    size, want = plain_targets(rows)
    of, plan, parts = taken(spark, rows, block, shard)
    got = {r["source"]: r for r in of.collect()}
    assert {s: r["source_size"] for s, r in got.items()} == dict(size)
    assert all(abs(r["target"] - want[s]) < 1e-6 for s, r in got.items())
    slots = plan.collect()
    by = Counter()
    for r in slots:
        by[r["src"]] += r["take"]
    assert all(by[r["src"]] == r["words"] for r in got.values())
    assert all(n == shard for k, n in Counter(r["shard"] for r in slots).items() if k < max(x["shard"] for x in slots))
    for src in {r["src"] for r in slots}:  # each pass over a source takes each block once
        own = sorted((r["nth"], r["block"]) for r in slots if r["src"] == src)
        blocks = next(r["blocks"] for r in got.values() if r["src"] == src)
        assert [n for n, _ in own] == list(range(len(own)))
        for k in range(0, len(own) - blocks + 1, blocks):
            assert sorted(b for _, b in own[k : k + blocks]) == list(range(blocks))
    for r in parts.collect():
        assert sum(max(0, min(t, r["hi"]) - r["lo"]) for t in r["takes"] or []) <= 3 * (r["hi"] - r["lo"])


def test_the_mix_holds_the_words_of_its_blocks(spark):
    rows = some(120)
    block = 16
    got = mixing.mixed(table(spark, rows), block=block, shard=8).collect()
    of = {r["src"]: r for r in mixing.targets(mixing.sized(table(spark, rows)), block).collect()}
    stream = defaultdict(list)
    for _, t, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest())):
        stream[s] += (t or "").split()
    plan = {(r["src"], r["nth"]): r for r in mixing.plan(mixing.targets(mixing.sized(table(spark, rows)), block), block, 8).collect()}
    assert len(got) == len(plan)
    for r in got:
        p = plan[r["src"], r["nth"]]
        assert r["words"] == stream[of[r["src"]]["source"]][p["block"] * block :][: p["take"]]


def test_permutations_are_permutations_and_differ(spark):
    n = 97
    a, b = [[r[0] for r in spark.range(n).orderBy("id").select(mixing.permuted(F.col("id"), F.lit(n), k)).collect()] for k in ("a", "b")]
    assert sorted(a) == sorted(b) == list(range(n)) and a != b
    assert sum(x == i for i, x in enumerate(a)) < 8
    assert [r[0] for r in spark.range(1).select(mixing.permuted(F.col("id"), F.lit(1), "a")).collect()] == [0]


def test_draws_are_multinomial_before_they_settle(spark):
    of = spark.createDataFrame([(0, 3000), (1, 900), (2, 100), (3, 0)], "src long, slots long")
    counts = mixing.drawn(spark, of, 4000, 100).collect()
    shards = Counter()
    for r in counts:
        shards[r["shard"]] += r["n"]
    assert shards == Counter(dict.fromkeys(range(40), 100))
    first = [r["n"] for r in counts if r["src"] == 0]
    assert abs(sum(first) - 3000) < 150 and len(set(first)) > 5 and all(50 < n < 95 for n in first)
    settled = mixing.settled(mixing.drawn(spark, of, 4000, 100), of).collect()
    total, shards = Counter(), Counter()
    for r in settled:
        total[r["src"]] += r["n"]
        shards[r["shard"]] += r["n"]
    assert total == {0: 3000, 1: 900, 2: 100} and set(shards.values()) == {100}


def test_no_rows_and_no_words(spark):
    for rows in ([], [(1, None, "a"), (2, "", None)]):
        of, plan, parts = taken(spark, rows, 8, 8)
        assert plan.count() == 0 and parts.count() == len(rows)
        assert all(r["target"] == 0 and r["words"] == 0 for r in of.collect())


def test_query_is_native_and_repeatable(spark, tmp_path):
    table(spark, some()).write.parquet(str(tmp_path / "documents.parquet"))
    a, b = [sorted(mixing.query(spark, str(tmp_path)).collect(), key=repr) for _ in range(2)]
    assert a == b and len(a) == len(some())
    plan = mixing.query(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_running_sums_over_a_hot_key(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    before = Counter()
    want = {}
    for o in range(1000):
        k = int(o % 10 == 0)
        want[o] = before[k]
        before[k] += o % 7
    assert {r["o"]: r["s"] for r in common.running(df, ["k"], [F.col("o")], s="v").collect()} == want
