"""Line dedup by spread over distinct sites: lines that many sites share are boilerplate and go, but for one place.

Lines are split at line feeds and trimmed of blanks; a line counts if it has at least `min_chars` code
points. HyperLogLog sketches of the sites (null sites count for none) are merged for each line hash by the
aggregation; where the estimate is too near the threshold to trust, the distinct sites are counted exactly.
A line on `min_sites` sites or more is removed from every document except at its first place, the least
(doc_id, hash of text, line number), so that no text is lost altogether. The hash is 64 bits wide and joined by the
line's length.

Nulls: a null text stays null and has no lines; a null doc_id sorts first. Rows that repeat a doc_id are
told apart by their texts; rows that repeat id and text are alike, and what one of them keeps all of them keep. Empty tables give empty results; extra columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import checkpoint, fresh

MIN_SITES, MIN_CHARS, LG_K = 5, 10, 12
#: Boilerplate lines that are broadcast at most (about 50 bytes each); more are joined by a shuffle, whose hot lines Spark splits.
BROADCAST_LINES = 200_000


def exploded(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__id, __t, __site, __at, __h, __n): a row for each line that counts. __id and __t name the document's row."""
    line = F.trim(F.col("__line"))
    rows = docs.select(*_row_key("__id", "__t"), F.col("source").alias("__site"), F.posexplode(F.split("text", "\n")).alias("__at", "__line"))
    return rows.where(F.length(line) >= min_chars).select("__id", "__t", "__site", "__at", F.xxhash64(line).alias("__h"), F.length(line).alias("__n"))


def _row_key(id_name: str, text_name: str) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias(id_name), F.xxhash64("text").alias(text_name)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(__h, __n, __first): the lines on min_sites sites or more and their first place."""
    sketched = checkpoint(
        lines.groupBy("__h", "__n")
        .agg(F.hll_sketch_agg("__site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("rows"), F.min(F.struct("__id", "__t", "__at")).alias("__first"))
        .where(F.col("rows") >= min_sites)  # a line has no more sites than rows
        .select("__h", "__n", "__first", F.hll_sketch_estimate("sketch").alias("about"))
    )
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(2**LG_K) * min_sites))
    near = sketched.where(F.abs(F.col("about") - min_sites) <= band)
    sites = lines.where("__site is not null").select("__h", "__n", "__site").distinct()  # map-side, so that a hot line has few rows
    exact = sites.join(near.select("__h", "__n"), ["__h", "__n"], "left_semi").groupBy("__h", "__n").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    sure = sketched.where(F.col("about") > min_sites + band)
    return sure.select("__h", "__n", "__first").unionByName(near.join(exact, ["__h", "__n"], "left_semi").select("__h", "__n", "__first"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, counts: tuple[str, str] | None = None, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines taken out of text. counts: names of two more columns, the lines of the text as it was and how many are gone."""
    lines = exploded(docs, min_chars)
    marked = checkpoint(boilerplate(lines, min_sites))
    if marked.count() <= broadcast:
        marked = F.broadcast(marked)
    gone = lines.join(marked, ["__h", "__n"]).where(~F.struct("__id", "__t", "__at").eqNullSafe(F.col("__first")))
    id_, t, places, parts = fresh(docs, "__id", "__t", "__gone", "__parts")
    gone = gone.select("__id", "__t", "__at").distinct().groupBy(F.col("__id").alias(id_), F.col("__t").alias(t)).agg(F.collect_list("__at").alias(places))
    rows = docs.select("*", *_row_key(id_, t)).join(gone, [id_, t], "left")
    # a column of its own, so that no line splits the text again
    rows = rows.withColumn(parts, F.when(F.col(places).isNotNull(), F.split("text", "\n")))
    # places, not lines, are taken away: by hash, so that a text of many lines takes time in proportion
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places)
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    more = [n.alias(counts[0]), F.coalesce(F.size(places), F.lit(0)).alias(counts[1])] if counts else []
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """docs with boilerplate removed; documents of which nothing but blanks is left go."""
    n, removed = fresh(docs, "__lines", "__removed")
    c = clean(docs, counts=(n, removed))
    return c.where((F.col(removed) == 0) | (F.length(F.trim(F.translate("text", "\n", " "))) > 0)).select(*[F.col(f"`{x}`") for x in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    c = clean(docs, counts=("n_lines", "n_removed"))
    return c.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
  SELECT trim(line, ' ') AS t, min(struct_pack(d := doc_id, p := pos)) AS f FROM l
  WHERE length(trim(line, ' ')) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), m AS (
  SELECT l.doc_id, l.pos, l.line, b.t IS NOT NULL AND (l.doc_id <> b.f.d OR l.pos <> b.f.p) AS gone
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.t
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM m GROUP BY doc_id
"""
