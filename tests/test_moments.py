"""Window statistics from running moments, and exact quantiles from sketches, against plain versions."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import moments as M
from podium.operators import quantiles as Q

NAN = float("nan")


def test_windows_equal_plain_sums(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice([k * 0.25, rnd.random() * 60]), rnd.choice([None, NAN, rnd.random(), rnd.random(), rnd.random() * 9]), rnd.choice([None, NAN, rnd.random(), 1.0])) for c in (1, 2) for t in (10, 100) for k in range(200)]
    rows += [(3, 10, float(k), 0.5, 0.5) for k in range(20)] + [(4, 10, 1.0, 2.0, None)]
    windows = [(f"w{i}", c, t, lo := rnd.choice([0.0, 5.0, rnd.random() * 40]), lo + rnd.choice([0.0, 0.1, 20.0, 60.0])) for i in range(60) for c in (1, 2, 3, 4) for t in (10, 100)]
    df = spark.createDataFrame(rows, "contest_id long, tier int, hours double, skeleton_speed double, norm_speed double")
    ws = spark.createDataFrame(windows, "w string, contest_id long, tier int, lo double, hi double")
    want = {}
    good = lambda x: x is not None and not math.isnan(x)
    for w, c, t, lo, hi in windows:
        inside = [r for r in rows if r[:2] == (c, t) and lo <= r[2] <= hi]
        s, v = [r[3] for r in inside if good(r[3])], [r[4] for r in inside if good(r[4])]
        if s or v:
            mean = sum(s) / len(s) if s else None
            std = statistics.stdev(s) if len(s) > 1 else None
            kept = [x for x in s if abs(x - mean) < 2 * std] if std and std > 0.001 else s
            want[w, c, t] = (sum(kept or s) / len(kept or s) if s else None, sum(v) / len(v) if v else None)
    got = {(r["w"], r["contest_id"], r["tier"]): (r["intensity"], r["norm_mean"]) for r in M.window_statistics(df, ws, ["w"]).collect()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k][0] == (a if a is None else pytest.approx(a, abs=1e-9)) and got[k][1] == (b if b is None else pytest.approx(b, abs=1e-9)), k
    assert M.window_statistics(df.where("false"), ws, ["w"]).count() == 0


def test_rows_are_not_repeated_for_windows(spark):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("contest_id"), F.lit(10).alias("tier"), F.col("id").cast("double").alias("hours"), F.rand(1).alias("skeleton_speed"), F.rand(2).alias("norm_speed"))
    ws = spark.range(300).select(F.col("id").alias("w"), F.lit(1).cast("long").alias("contest_id"), F.lit(10).alias("tier"), F.lit(0.0).alias("lo"), F.lit(999.0).alias("hi"))
    plan = M.window_moments(df, ws, ["w"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_quantiles_are_exact(spark, broadcast):
    rnd = np.random.default_rng(2)
    groups = {"hot": rnd.normal(size=9000).round(2), "flat": np.ones(3000), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), None: rnd.random(500)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("hot", None), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    names = {"lo": 0.0, "q1": 0.01, "half": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "v", names, accuracy=100, small=400, broadcast=broadcast).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k]["n"] == len(x)
        assert [got[k][n] for n in names] == pytest.approx([float(np.quantile(x, q)) for q in names.values()], abs=1e-12)
    assert Q.exact_quantiles(df.where("false"), ["k"], "v", names).count() == 0
    # of the hot group few values are looked at one by one
    plan = Q.exact_quantiles(df, ["k"], "v", names)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median" not in plan
