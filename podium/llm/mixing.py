"""Mixing sources to target weights, with DataFrame functions alone.

Each source's words are packed into blocks of `BLOCK` words, in the order of (doc_id, MD5 of the text); the last
block of a source may be shorter. The mix is cut into output shards of `SHARD` slots. For every slot of a shard a
source is drawn, which gives each shard multinomial counts of sources; what a source draws beyond its quota goes to
sources that drew too little, so that every source meets its target to the word. A source's slots, numbered through
all shards, go through pseudorandom permutations of its blocks' numbers (swap-or-not), a new one each time the
source is used up; the short block closes each pass, and the last slot may take the first words of its block only.
Blocks join the slots by (source, number).

A source's target is its weight's share of all words, at most `MOST` times its own; what goes beyond is shared among
the others by weight, until none is above.

Defined results: a null text, or one without a word, has size 0 and is never taken; null sources are one source, the
last; null ids come first in their source; repeated rows are packed, and taken, each by itself; no rows, or no words,
give an empty plan and targets of 0; other columns are not looked at. Draws and permutations are MD5 values, so reruns
agree on any cluster. Sources may be any number; one with a third of all rows is spread over tasks like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import checkpoint, partitions, running

BLOCK, SHARD, ROUNDS, SEED, WEIGHTS, MOST = 2048, 1024, 24, "mix", (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Sources (about 100 bytes each) that are broadcast at most; more are joined by a shuffle, whose hot keys Spark splits.
BROADCAST_SOURCES = 100_000


def draw(*parts) -> Column:
    """A number of 60 bits from the MD5 of the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(i: Column, n: Column, *key, rounds: int = ROUNDS) -> Column:
    """The place of i in a pseudorandom permutation of 0..n-1 (n over 0): in each round i and its partner swap, or not."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(draw(*key, r, "k"), n) - x, n)
        return F.when(draw(*key, r, F.greatest(x, partner)) % 2 == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), swap)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of each row; tie tells rows of one id apart. Written once."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return checkpoint(docs.select("doc_id", "source", size.alias("size"), F.md5(F.col("text").cast("binary")).alias("tie")))


def targets(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: src (its number by code point, null last), source_size, target, and how its blocks and slots are cut. docs: sized.

    blocks: of which `even` are full; words: the target in whole words; passes: over all blocks; slots: in all.
    """
    of = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    of = running(of.withColumn("one", F.lit(1)), [], [F.col("source").isNull(), F.col("source")], src="one").drop("one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("long")
    of = checkpoint(of.select("source", "src", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")))
    total, heavy = of.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, capped = 0.0, (0, 0)
    while total:  # the level rises until no more sources reach their caps; each pass sums the small table of sources
        level = max(level, (total - capped[0]) / (heavy - capped[1]))
        now = tuple(of.where(F.col("cap") <= F.col("weight") * level).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first())
        if now == capped:
            break
        capped = now
    target = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    of = of.withColumn("target", F.when(F.lit(total > 0), target).otherwise(0.0)).withColumn("words", F.floor(F.col("target") + 0.5))
    even, blocks = F.floor(F.col("source_size") / block), F.ceil(F.col("source_size") / block)
    of = of.withColumns({"even": even, "blocks": blocks, "passes": F.coalesce(F.floor(F.try_divide("words", "source_size")), F.lit(0))})
    rest = F.col("words") - F.col("passes") * F.col("source_size")
    return checkpoint(of.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(rest / block)))


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def drawn(spark: SparkSession, of: DataFrame, total: int, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """(shard, src, n): each shard's multinomial counts, every slot drawing a source with the chance slots / total."""
    spans = running(of.where("slots > 0").select("src", "slots"), [], [F.col("src")], lo="slots")
    width = max(1, total // (2 * max(1, spans.count())))  # about two cells a source: a cell meets few sources, and few slots
    cell = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("slots") - 1) / width)))
    spans = spans.select("src", "lo", (F.col("lo") + F.col("slots")).alias("hi"), cell.alias("cell"))
    slot = F.explode(F.sequence(F.lit(0), F.least(F.lit(shard), F.lit(total) - F.col("id") * shard) - 1))
    slots = spark.range(-(-total // shard)).select(F.col("id").alias("shard"), slot.alias("k")).select("shard", F.pmod(draw(seed, F.col("shard"), F.col("k")), F.lit(total)).alias("r"))
    met = slots.withColumn("cell", F.floor(F.col("r") / width)).join(_small(spans), "cell").where("r >= lo and r < hi")
    return met.groupBy("shard", "src").agg(F.count("*").alias("n"))


def settled(counts: DataFrame, of: DataFrame, seed: str = SEED) -> DataFrame:
    """counts (shard, src, n) with every source at its slots: its last draws beyond them go, in a permuted order, to sources that drew too few."""
    counts = running(counts, ["src"], [F.col("shard")], before="n").join(_small(of.select("src", "slots")), "src")
    kept = F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("before")))
    counts = checkpoint(counts.select("shard", "src", kept.alias("n"), (F.col("n") - kept).alias("over")))
    lack = of.select("src", "slots").join(counts.groupBy("src").agg(F.sum("n").alias("had")), "src", "left").select("src", (F.col("slots") - F.coalesce("had", F.lit(0))).alias("lack")).where("lack > 0")
    loose = counts.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    unit = lambda n: F.explode(F.sequence(F.col("unit"), F.col("unit") + F.col(n) - 1)).alias("unit")
    free = running(counts.where("over > 0").select("shard", "src", "over"), [], [F.col("shard"), F.col("src")], unit="over").select("shard", unit("over"))
    due = running(lack, [], [F.col("src")], unit="lack").select("src", unit("lack")).withColumn("unit", permuted(F.col("unit"), F.lit(max(1, loose)), seed, "loose"))
    moved = free.join(due, "unit").select("shard", "src", F.lit(1).cast("long").alias("n"))
    return counts.select("shard", "src", "n").where("n > 0").unionByName(moved).groupBy("shard", "src").agg(F.sum("n").alias("n"))


def plan(of: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """(shard, src, nth, block, take): which block of which source each slot of the mix takes, and how many of its words from the first on. nth counts a source's slots through all shards."""
    total = of.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not total:
        return of.where("false").select(F.lit(0).cast("long").alias("shard"), "src", *[F.lit(0).cast("long").alias(c) for c in ("nth", "block", "take")])
    counts = running(settled(drawn(of.sparkSession, of, total, shard, seed), of, seed), ["src"], [F.col("shard")], first="n")
    slots = counts.select("shard", "src", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("nth"))
    slots = slots.repartition(partitions(of.sparkSession), "src", "nth")  # few counts stand for many slots, and lie in few tasks
    slots = slots.join(_small(of.select("src", "source", "source_size", "even", "blocks", "passes", "words")), "src")
    lap, i = F.floor(F.col("nth") / F.col("blocks")), F.col("nth") % F.col("blocks")
    name = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source")))
    at = F.when(i < F.col("even"), permuted(i, F.greatest("even", F.lit(1)), seed, name, lap)).otherwise(i)
    length = F.when(i < F.col("even"), F.lit(block)).otherwise(F.col("source_size") - F.col("even") * block)
    left = F.when(lap == F.col("passes"), F.col("words") - lap * F.col("source_size") - i * block).otherwise(length)
    return slots.select("shard", "src", "nth", at.alias("block"), F.least(length, left).cast("long").alias("take"))


def placed(docs: DataFrame, of: DataFrame) -> DataFrame:
    """sized rows with src, `at` (words of their source before them) and `nth` (rows before them)."""
    rows = docs.join(_small(of.select("source", "src")).withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return running(rows.withColumn("one", F.lit(1)), ["src"], [F.col("doc_id"), F.col("tie")], at="size", nth="one").drop("one")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed rows cut at the blocks' ends: `block`, and lo and hi, the piece's place in it. A row without words has one empty piece."""
    last = F.greatest(F.col("at"), F.col("at") + F.col("size") - 1)
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor(last / block))))
    start = F.col("block") * block
    return cut.withColumns({"lo": F.greatest(F.col("at") - start, F.lit(0)), "hi": F.least(F.col("at") + F.col("size") - start, F.lit(block))})


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """(shard, src, nth, words array): the mix itself. docs: (doc_id, source, text); what a slot takes is a block's words at most.

    The pieces of a block meet its slots by (src, block), so each text is cut into words once.
    """
    block = settings.get("block", BLOCK)
    size = sized(docs)
    of = targets(size, block, settings.get("weights", WEIGHTS), settings.get("most", MOST))
    slots = plan(of, block, settings.get("shard", SHARD), settings.get("seed", SEED))
    # rows that are alike but for their number hold the same words: each takes one number of theirs
    key = ["doc_id", "source", "tie"]
    where = placed(size, of).groupBy(*key).agg(F.collect_list(F.struct("src", "at", "size", "nth")).alias("copies"))
    texts = docs.select("doc_id", "source", "text", F.md5(F.col("text").cast("binary")).alias("tie")).dropDuplicates(key)
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
    rows = texts.alias("t").join(where.alias("p"), same).select("t.text", F.explode("p.copies").alias("c")).select("c.*", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    parts = pieces(rows, block).where("hi > lo")
    parts = parts.select("src", "block", "lo", "hi", F.slice("words", (F.col("block") * block + F.col("lo") - F.col("at") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("words"))
    got = parts.join(slots, ["src", "block"]).where("lo < take")
    got = got.groupBy("shard", "src", "nth", "take").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "words"))), lambda x: x["words"])).alias("words"))
    return got.select("shard", "src", "nth", F.slice("words", F.lit(1), F.col("take").cast("int")).alias("words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = sized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    of = targets(size)
    # a block lies in at most MOST slots, since no target is above MOST times its source
    takes = plan(of).groupBy("src", "block").agg(F.collect_list("take").alias("takes"))
    each = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.least(t, F.col("hi")) - F.col("lo"), F.lit(0)))
    parts = pieces(placed(size, of)).join(takes, ["src", "block"], "left").select("src", "nth", "doc_id", "size", F.coalesce(each, F.lit(0)).alias("n"))
    rows = parts.groupBy("src", "nth", "doc_id", "size").agg(F.sum("n").alias("taken"))
    return rows.join(_small(of.select("src", "source_size", "target")), "src").select("doc_id", "size", "source_size", "target", "taken")


_DRAW = "CAST('0x' || substr(md5(concat_ws(':', {})), 1, 15) AS BIGINT)"
_KEY = f"'{SEED}', CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END, CAST(nth // blocks AS VARCHAR), CAST(k AS VARCHAR)"
_PARTNER = f"(({_DRAW.format(_KEY + ", 'k'")} % even - x + even) % even)"
#: What each document gives does not depend on the shards' draws, since every source meets its slots: the twin needs the permutations alone.
ORACLE_SQL = f"""
WITH sz AS (
  SELECT doc_id, source, md5(text) AS tie, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS src FROM sz GROUP BY source
), s1 AS (
  SELECT *, {list(WEIGHTS)}[src % {len(WEIGHTS)} + 1] AS weight, {MOST} * source_size AS cap, sum(source_size) OVER () AS t FROM s0
), s2 AS (
  SELECT *, cap / weight <= (t - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS full_
  FROM s1 WINDOW b AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, CASE WHEN t = 0 THEN 0.0 WHEN full_ THEN CAST(cap AS DOUBLE) ELSE weight * (CAST(t - coalesce(sum(cap) FILTER (full_) OVER (), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) FILTER (full_) OVER (), 0) AS DOUBLE)) END AS target FROM s2
), s4 AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, source_size // {BLOCK} AS even, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS passes FROM s4
), slots AS (
  SELECT *, unnest(range(passes * blocks + (words - passes * source_size + {BLOCK - 1}) // {BLOCK})) AS nth FROM s5
), perm AS (
  SELECT *, CASE WHEN nth % blocks < even THEN list_reduce(list_prepend(nth % blocks, range(1, {ROUNDS + 1})), lambda x, k:
      CASE WHEN {_DRAW.format(_KEY + f", CAST(greatest(x, {_PARTNER}) AS VARCHAR)")} % 2 = 1 THEN {_PARTNER} ELSE x END) ELSE nth % blocks END AS block FROM slots
), takes AS (
  SELECT src, block, least(CASE WHEN nth % blocks < even THEN {BLOCK} ELSE source_size - even * {BLOCK} END,
    CASE WHEN nth // blocks = passes THEN words - passes * source_size - (nth % blocks) * {BLOCK} ELSE {BLOCK} END) AS take FROM perm
), rows_ AS (
  SELECT sz.doc_id, sz.size, s3.source_size, s3.target, s3.src, row_number() OVER () AS nr,
    coalesce(sum(sz.size) OVER (PARTITION BY s3.src ORDER BY sz.doc_id NULLS FIRST, sz.tie NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sz JOIN s3 ON sz.source IS NOT DISTINCT FROM s3.source
), parts AS (
  SELECT *, unnest(range(CAST(pos // {BLOCK} AS BIGINT), CAST(greatest(pos, pos + size - 1) // {BLOCK} + 1 AS BIGINT))) AS block FROM rows_
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(coalesce(sum(greatest(0, least(coalesce(take, 0), pos + size - block * {BLOCK}) - greatest(0, pos - block * {BLOCK}))), 0) AS BIGINT) AS taken
FROM parts LEFT JOIN takes USING (src, block) GROUP BY nr
"""
