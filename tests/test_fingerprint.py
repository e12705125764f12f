"""Trees of digests: order-free, and a late row changes one branch."""

import random

from pyspark.sql import functions as F

from podium.operators import fingerprint as P

H = 3_600_000


def test_a_late_row_changes_one_branch(spark):
    rows = [(1, t, k * H // 3, k, float(k)) for t in (10, 100) for k in range(900)]
    mixed = random.Random(1).sample(rows, len(rows))
    frame = lambda r: spark.createDataFrame(r, "contest_id long, tier int, time_ms long, seq long, score double")
    tree = lambda r: P.digest_tree(frame(r), ["contest_id", "tier"], F.col("score").cast("string"), ["time_ms", "seq"], fan=4, levels=3)
    nodes = lambda t: {(r["tier"], r["level"], r["node"]): (r["n"], r["digest"]) for r in t.collect()}
    old, new = tree(rows), tree([*mixed, (1, 10, 50 * H + 1, 9999, 7.0)])
    a, b = nodes(old), nodes(new)
    assert a == nodes(tree(mixed)) and a.keys() == b.keys()
    assert {k for k in a if a[k] != b[k]} == {(10, 0, 50), (10, 1, 12), (10, 2, 3), (10, 3, 0), (10, 4, 0)}
    assert [tuple(r) for r in P.changed_leaves(old, new, ["contest_id", "tier"]).collect()] == [(1, 10, 50)]
    assert {r["tier"]: r["n"] for r in P.roots(new, ["contest_id", "tier"], 3).collect()} == {10: 901, 100: 900}
    assert P.roots(tree(rows).where("false"), ["contest_id", "tier"], 3).count() == 0
