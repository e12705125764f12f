"""Conversation structure repair: the cheapest edits that give a conversation the roles (system)? (user assistant)+.

A conversation becomes a string of symbols, one a row. How much the rest of it costs from each of four states (start,
after system, after user, after assistant) is a vector of four numbers whose differences are bounded, so there are few
such vectors up to a common summand. For every block of `BLOCK` symbols and every vector a table holds the vector in
front of the block and what the block adds: conversations are processed from the end, a block a look-up, many at once.
Only the vector at the right end of each block is kept. The trace then goes forward: a block is expanded backward from
its right end, and at each symbol the least letter (D, I, K, R) that loses nothing is taken, which gives the least of
all cheapest edit strings. Vectors and tables are found at the start, from the costs alone.

Rows are damaged, judged (blank, duplicate, truncated), numbered and put into symbols by Spark, without their texts:
copies of a row are one row with a count, and a duplicate is known by the first turn of its role and text. Strings of
`SEGMENT` rows are put together first, so what a task holds of one conversation is a byte a row, as the audit that is
returned. Texts join the edits that keep them, and the repaired conversation is hashed as it streams by.

Defined results: in the damage nulls of role and text, and of ids and turns within the hash, are one space. A null
conv_id is a conversation; null turns come first; rows of one turn go by role, then by the MD5 of their texts, so
equal rows are adjacent. An empty role, or one with another initial than s, u and a, can only be deleted or changed.
A conversation without rows has zeros, an empty audit and the hash of the empty string. Gaps that do not fit a long
are null. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of, checkpoint, partitions, running

BLOCK, SEGMENT, BATCH = 4, 256, 400_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
OK, CUT, TWICE, BLANK = range(4)
#: A letter for each role (s, u, a, other) and fault (none, truncated, duplicate, blank).
LETTERS = "abcdefghijklmnop"
#: States: 0 start, 1 after system, 2 after user, 3 after assistant. What role is needed next, and where it leads; 0 and 3 may end.
NEEDED, LEADS, FINAL = "uuau", (2, 2, 3, 2), (0, 3)
#: Symbols: 2 * role + truncated; a row that must go; nothing, which fills a block.
GONE, NOTHING = 8, 9
SYMBOL = np.array([GONE if f in (TWICE, BLANK) else 2 * r + f for r, f in itertools.product(range(4), range(4))], np.int64)
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage, by crc32 of conv_id:turn modulo 20."""
    at = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(at.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    role = F.when(kind == 4, "user").otherwise(role)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _keys() -> list[Column]:
    return [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("at")]


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary")).alias("digest")


def judged(rows: DataFrame) -> DataFrame:
    """One row for all copies of a row: (conv, at, turn, role, digest, copies, fault), without text. rows: (conv_id, turn, role, text, copies), none of the last three null."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), OK).otherwise(CUT)
    slim = rows.select(*_keys(), "turn", "role", _digest(), "copies", own.alias("fault"))
    slim = slim.groupBy("conv", "at", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.max("fault").alias("fault"))
    slim = checkpoint(slim.withColumn("order", F.struct(F.col("turn").isNotNull().alias("is"), "turn")))
    first = slim.groupBy("conv", "role", "digest").agg(F.min("order").alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    slim = slim.join(first, ["conv", "role", "digest"], "left")
    again = F.col("first").isNotNull() & (F.col("order") > F.col("first")) & (F.col("fault") != BLANK)
    return slim.select("conv", "at", "turn", "role", "digest", "copies", F.when(again, TWICE).otherwise(F.col("fault")).alias("fault"))


def symbols(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their places, (.., nth, place), and strings of letters, (conv, part, letters), SEGMENT rows each. A row's copies are duplicates."""
    rows = checkpoint(running(rows.withColumn("one", F.lit(1)), ["conv"], [F.col("turn"), F.col("role"), F.col("digest")], nth="one", place="copies").drop("one"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    letter = lambda fault: F.substr(F.lit(LETTERS), initial * 4 + fault + 1, F.lit(1))
    unit = F.concat(letter(F.col("fault")), F.repeat(letter(F.greatest(F.col("fault"), F.lit(TWICE))), (F.col("copies") - 1).cast("int")))
    part = F.floor(F.col("nth") / SEGMENT)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", unit.alias("unit")))), lambda r: r["unit"]), "")
    return rows, rows.groupBy("conv", part.alias("part")).agg(joined.alias("letters"))


# -- block tables


def _closed(cost: list[float]) -> tuple:
    for _ in range(4):
        cost = [min(cost[q], INSERT + cost[LEADS[q]]) for q in range(4)]
    return tuple(cost)


def _choices(symbol: int, right: tuple, q: int) -> list[tuple[str, float, int]]:
    """What may be done with a row in state q: (letter, cost of it and of the rest, next state)."""
    out = [("D", DELETE + right[q], q)]
    if symbol < GONE:
        role, extra = "suao"[symbol // 2], TRUNCATED * (symbol % 2)
        if role == NEEDED[q] or (role, q) == ("s", 0):
            to = 1 if role == "s" else LEADS[q]
            out.append(("K", KEEP + extra + right[to], to))
        out.append(("R", REROLE + extra + right[LEADS[q]], LEADS[q]))
    return out


@lru_cache
def tables(block: int = BLOCK) -> dict:
    """All vectors, and what each symbol, and each block of symbols, makes of each.

    step[s, v], step_add: the vector in front of symbol s when v is behind it, and what is added; jump, jump_add: the same
    for blocks; act[s, v, q], to: which of `edits` is made at symbol s in state q, and the state after it.
    """
    end = _closed([0 if q in FINAL else np.inf for q in range(4)])
    base = lambda c: (tuple(x - min(c) for x in c), min(c))
    vectors, known, step, step_add = [base(end)[0]], {base(end)[0]: 0}, [], []
    for v in vectors:  # grows as new ones are found
        for s in range(NOTHING + 1):
            front = v if s == NOTHING else _closed([min(c for _, c, _ in _choices(s, v, q)) for q in range(4)])
            front, add = base(front)
            if front not in known:
                known[front] = len(vectors)
                vectors.append(front)
            step.append(known[front])
            step_add.append(add)
    n = len(vectors)
    step, step_add = np.array(step, np.int32).reshape(n, -1).T.copy(), np.array(step_add, np.int32).reshape(n, -1).T.copy()
    edits, number = [""], {"": 0}
    act, to = np.zeros((NOTHING + 1, n, 4), np.int32), np.tile(np.arange(4, dtype=np.int32), (NOTHING + 1, n, 1))
    for s, v, q in itertools.product(range(NOTHING), range(n), range(4)):
        state, done, right = q, "", vectors[v]
        front = _closed([min(c for _, c, _ in _choices(s, right, p)) for p in range(4)])
        while True:  # the least letter that loses nothing; an inserted row leaves the symbol where it is
            options = [*_choices(s, right, state), ("I", INSERT + front[LEADS[state]], LEADS[state])]
            letter, _, after = min(o for o in options if o[1] == front[state])
            done += {"I": NEEDED[state], "R": NEEDED[state].upper()}.get(letter, letter)
            state = after
            if letter != "I":
                break
        if done not in number:
            number[done] = len(edits)
            edits.append(done)
        act[s, v, q], to[s, v, q] = number[done], state
    jump, jump_add = step, step_add
    for _ in range(block - 1):  # one more symbol in front
        jump, jump_add = step[:, jump].reshape(-1, n), (step_add[:, jump] + jump_add[None]).reshape(-1, n)
    return {"vectors": vectors, "step": step, "jump": jump, "jump_add": jump_add, "act": act, "to": to, "edits": edits, "end": (0, int(base(end)[1])), "block": block}


#: What is inserted at the end in each state.
TAIL = ("", "ua", "a", "")
_SHOWN = str.maketrans("uaUA", "IIRR")


def solve(strings: list[bytes], block: int = BLOCK) -> tuple[list[int], list[list[str]]]:
    """The cost of each string of letters, and for each of its letters what is done: inserted roles (u, a), then K, D, or a new role (U, A); what is inserted at the end follows the last."""
    t = tables(block)
    lengths = np.array([len(s) for s in strings], np.int64)
    costs, done = [0] * len(strings), [[] for _ in strings]
    edits = np.array(t["edits"], object)
    blocks = -(-lengths // block)
    for nb in np.unique(blocks[blocks > 0]):
        which = np.flatnonzero(blocks == nb)
        own = np.full((len(which), nb * block), NOTHING, np.int64)
        for i, k in enumerate(which):
            own[i, nb * block - lengths[k] :] = SYMBOL[np.frombuffer(strings[k], np.uint8) - ord(LETTERS[0])]
        powers = (NOTHING + 1) ** np.arange(block - 1, -1, -1)
        codes = own.reshape(len(which), nb, block) @ powers
        right = np.zeros((nb, len(which)), np.int32)
        v, cost = np.full(len(which), t["end"][0], np.int32), np.full(len(which), t["end"][1], np.int64)
        for b in range(nb - 1, -1, -1):
            right[b] = v
            cost += t["jump_add"][codes[:, b], v]
            v = t["jump"][codes[:, b], v]
        cost += np.array([x[0] for x in t["vectors"]], np.int64)[v]
        acts, q = np.zeros_like(own), np.zeros(len(which), np.int32)
        for b in range(nb):
            behind = [right[b]]
            for j in range(block - 1, 0, -1):
                behind.append(t["step"][own[:, b * block + j], behind[-1]])
            for j, v in enumerate(reversed(behind)):
                s = own[:, b * block + j]
                acts[:, b * block + j], q = t["act"][s, v, q], t["to"][s, v, q]
        for i, k in enumerate(which):
            costs[k] = int(cost[i])
            done[k] = edits[acts[i, nb * block - lengths[k] :]].tolist()
            done[k][-1] += TAIL[q[i]]
    return costs, done


def _summary(letters: bytes, cost: int, done: list[str]) -> tuple:
    x = np.frombuffer(letters, np.uint8) - ord(LETTERS[0])
    role, fault = x // 4, x % 4
    legal = np.zeros((4, 4), bool)
    for a, b in LEGAL:
        legal["sua".index(a), "sua".index(b)] = True
    return int((fault == BLANK).sum()), int((fault == TWICE).sum()), int((fault == CUT).sum()), int((~legal[role[:-1], role[1:]]).sum()), cost, "".join(done).translate(_SHOWN)


_SOLVED = "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, place array<bigint>, edit array<string>"


def solved(strings: DataFrame, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """For each conversation its counts, cost and audit, and the edits that leave or insert a row, with their places.

    A conversation's parts come in order, one after the other; a task holds the letters of about `batch` rows, or of one
    conversation. Long lists of edits go into rows of their own, whose counts are null. Written once.
    """
    schema = arrow_schema(_SOLVED)

    def finish(held: list[tuple[str, bytes]]):
        out = []
        for (conv, letters), cost, done in zip(held, *solve([s for _, s in held], block), strict=True):
            kept = [(i, e) for i, e in enumerate(done) if e != "D"]
            head = (conv, *_summary(letters, cost, done))
            for lo in range(0, max(1, len(kept)), 4096):
                out.append((*(head if lo == 0 else (conv, *[None] * 6)), [i for i, _ in kept[lo : lo + 4096]], [e for _, e in kept[lo : lo + 4096]]))
        return batch_of(schema, [list(c) for c in zip(*out, strict=True)])

    def run(batches):
        held, size, now, parts = [], 0, None, []
        for b in batches:
            for conv, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if conv != now and parts:
                    held.append((now, "".join(parts).encode()))
                    parts = []
                    if size >= batch:
                        yield finish(held)
                        held, size = [], 0
                now = conv
                parts.append(letters)
                size += len(letters)
        if parts:
            held.append((now, "".join(parts).encode()))
        if held:
            yield finish(held)

    dealt = strings.repartition(partitions(strings.sparkSession), "conv").sortWithinPartitions("conv", "part").select("conv", "letters")
    return checkpoint(dealt.mapInArrow(run, _SOLVED))


def repaired_rows(rows: DataFrame, placed: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, step, role, text): the repaired conversations' rows, in the order of place and step. Inserted rows have empty texts."""
    edit = edits.select("conv", F.explode(F.arrays_zip("place", "edit")).alias("e")).select("conv", "e.place", "e.edit")
    key = ["conv", "at", "role", "digest"]
    texts = rows.select(*_keys(), "role", _digest(), "text").groupBy(*key).agg(F.any_value("text").alias("text"))
    kept = edit.join(placed.select(*key, "place"), ["conv", "place"], "left").join(texts, key, "left")
    named = F.transform(F.split("edit", ""), lambda c, i: F.struct(i.alias("step"), c.alias("c")))
    each = kept.select("conv", "place", F.explode(F.filter(named, lambda s: ~s["c"].isin("D", ""))).alias("s"), "role", "text")
    role = F.when(F.col("s.c") == "K", F.col("role")).when(F.lower("s.c") == "u", "user").otherwise("assistant")
    return each.select("conv", "place", "s.step", role.alias("role"), F.when(F.col("s.c").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines role:text, joined by line feeds; rows stream by, and no conversation is held."""
    ddl = "conv string, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield batch_of(schema, [list(c) for c in zip(*out, strict=True)])
        if sha:
            yield batch_of(schema, [[now], [sha.hexdigest()]])

    dealt = repaired.repartition(partitions(repaired.sparkSession), "conv").sortWithinPartitions("conv", "place", "step")
    return dealt.select("conv", "role", "text").mapInArrow(run, ddl)


def gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): how many turns between a conversation's least and greatest have no row; nulls don't count. rows: judged."""
    t = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("*")
    return t.agg(span.alias("gaps")).select("conv", F.col("gaps").try_cast("long").alias("gaps"), F.lit(True).alias("turns"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, copies): what is wrong and what is done, by conversation (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), and repaired_rows."""
    placed, strings = symbols(judged(rows))
    out = solved(strings)
    about = out.where("cost is not null").drop("place", "edit").join(gaps(placed), "conv", "left")
    about = about.withColumn("gaps", F.when(F.col("turns").isNull(), 0).otherwise(F.col("gaps"))).drop("turns")
    return about, repaired_rows(rows, placed, out.select("conv", "place", "edit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    about, rows = repair(damaged(table))
    all_ = table.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = all_.join(about, "conv", "left").join(digests(rows), "conv", "left")
    zeros = [F.when(F.col("cost").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
