"""Conversation repair against a plain search over all edits, and its odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from podium.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place long, FAULT string"
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
FULL = {"u": "user", "a": "assistant"}


def better(best, q, v):
    if q not in best or v[:2] < best[q][:2]:
        best[q] = v
        return True
    return False


def closed(best):
    again = True
    while again:
        again = False
        for q, (c, a, lines) in list(best.items()):
            r, to = NEXT[q]
            again |= better(best, to, (c + 3, a + "I", (*lines, FULL[r] + ":")))
    return best


def cheapest(rows):
    """rows: (role, text, fault). Forward over (cost, audit) of each state, every edit tried at every row."""
    best = closed({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for q, (c, a, lines) in best.items():
            better(new, q, (c + 4, a + "D", lines))
            if fault in ("", "truncated"):
                e, (r, to) = 3 * (fault == "truncated"), NEXT[q]
                if role[:1] == r:
                    better(new, to, (c + e, a + "K", (*lines, f"{role}:{text}")))
                if role[:1] == "s" and q == 0:
                    better(new, 1, (c + e, a + "K", (*lines, f"{role}:{text}")))
                better(new, to, (c + e + 3, a + "R", (*lines, f"{FULL[r]}:{text}")))
        best = closed(new)
    return min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])


def plain(table):
    convs = {}
    for c, t, r, x in table:
        own = convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else x.translate(str.maketrans("", "", ".!?")) if k == 2 else x
        own += [] if k == 0 else [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.md5(z[2].encode()).hexdigest()))
        turns, seen, judged = {z[0] for z in rows if z[0] is not None}, set(), []
        for _, r, x in rows:
            bare = x.strip(" \t\n\x0b\x0c\r")
            judged.append((r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((r, x))
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, lines = cheapest(judged)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows, tmp_path, n=3):
    at = str(tmp_path / str(random.random()))
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(n).write.parquet(f"{at}/conversations.parquet")
    return {r[0]: tuple(r)[1:] for r in repair.query(spark, at).collect()}


def odd(seed, n=60):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "u", "", None, "tool", "User"], ["Yes.", "No!", "why", "Is it?  \n", "", " \t\x0b", None, "…", "é.", "ok. then"]
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(0, 14)):
            rows.append((c, rnd.choice([t, t, t, t, 3, None, -5]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.random()}" + rnd.choice(".!? ,")))
    rows += rnd.sample(rows, 20) + [(None, 1, "user", "Hi."), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_a_plain_search(spark, tmp_path, seed):
    rows = odd(seed)
    assert result(spark, rows, tmp_path) == plain(rows)


def test_long_conversations_go_in_parts(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", f"n {t}.", f"cut {t}"])) for t in range(3 * repair.SEGMENT + 7)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"fine {t}.") for t in range(700)]
    assert result(spark, rows, tmp_path) == plain(rows)


def test_every_short_string_of_symbols_is_solved_at_least_cost():
    kinds = [(r, f) for r in ("s", "u", "a", "o") for f in range(2)] + [("u", 3)]
    fault = ("", "truncated", "duplicate", "blank")
    strings = [s for n in (1, 2, 3, 4, 5) for s in itertools.product(kinds, repeat=n) if n < 4 or hash(s) % (9 if n == 4 else 90) == 0]
    letters = [bytes(ord(repair.LETTERS["suao".index(r) * 4 + f]) for r, f in s) for s in strings]
    for block in (1, 3, 4):
        costs, done = repair.solve(letters, block)
        for s, cost, edits in zip(strings, costs, done, strict=True):
            assert (cost, "".join(edits).translate(str.maketrans("uaUA", "IIRR"))) == cheapest([(r, "x", fault[f]) for r, f in s])[:2], (s, block)


def test_no_rows_before_or_after_damage(spark, tmp_path):
    assert result(spark, [], tmp_path) == {}
    gone = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert result(spark, [(5, gone, "user", "Hi.")], tmp_path) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    wide = [(6, -(2**63), "user", "Hi."), (6, 2**63 - 1, "assistant", "Yes.")]
    assert result(spark, wide, tmp_path)[6][0] in (None, 0)


def test_repaired_rows_have_the_allowed_order(spark):
    rows = spark.createDataFrame([(*r, 1, "x") for r in odd(3)], SCHEMA)
    _, out = repair.repair(repair.damaged(rows))
    got = out.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "step", "role"))), lambda r: F.substring(r["role"], 1, 1)), "").alias("roles"))
    assert all(re.fullmatch("(s?(ua)+)?", r["roles"]) for r in got.collect())
