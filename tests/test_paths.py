"""Pace paths: prefixes that cannot be forecast fail with a reason, the others agree with the final forecast."""

import pytest
from pyspark.sql import functions as F

from podium.operators import models as M

H = 3_600_000
END = 60 * H
PREFIXES = {
    500: ([(0, 0.0), (10 * H, 50.0), (20 * H, 120.0)], None),
    1000: ([(10 * H, 50.0), (12 * H, 40.0)], "decreasing_score"),
    50: ([(10 * H, 50.0), (10 * H, 50.0)], "duplicate_time"),
    100: ([(10 * H, 0.0)], "no_score"),
    300: ([(0, 5.0), (10 * H, 50.0)], "score_at_start"),
    2000: ([(10 * H, -5.0)], "bad_score"),
    10: ([], "no_visible_row"),
}


def inputs(spark):
    rows = [(1, t, 24 * H, at, s) for t, (r, _) in PREFIXES.items() for at, s in r]
    p = spark.createDataFrame(rows, "contest_id long, tier int, origin_ms long, time_ms long, score double")
    c = spark.createDataFrame([(1, 0, END, END, "a")], "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")
    keys = spark.createDataFrame([(1, t, 24 * H) for t in PREFIXES], "contest_id long, tier int, origin_ms long")
    w = spark.createDataFrame([(0.34, 0.41, 0.25)], "w1 double, w2 double, w3 double")
    pressure = keys.select("contest_id", "tier", F.lit(0.6).alias("pressure"))
    return p, w, c, pressure, keys


def test_rejected_prefixes_have_reasons(spark):
    p, w, c, pressure, keys = inputs(spark)
    paths, bad = M.pace_paths(p, w, c, pressure, keys)
    assert {r["tier"]: r["reason"] for r in bad.collect()} == {t: why for t, (_, why) in PREFIXES.items() if why}
    assert {r["tier"] for r in paths.select("tier").distinct().collect()} == {500}


def test_paths_are_hourly_rise_and_end_at_the_forecast(spark):
    p, w, c, pressure, keys = inputs(spark)
    path = M.pace_paths(p, w, c, pressure, keys)[0].orderBy("hours").collect()
    assert [r["hours"] for r in path] == [float(h) for h in range(24, 61)]
    scores = [r["score"] for r in path]
    assert scores == sorted(scores) and scores[0] > 120 and all(r["speed"] >= 0 for r in path)
    good = p.where("tier = 500").select("contest_id", "tier", F.lit(24).alias("origin_h"), (F.col("time_ms") / H).alias("hours"), "score")
    assert scores[-1] == pytest.approx(M.forecast_pace(good, w, c, pressure).first()["final"])
    # the speed is the slope of the score
    fine = M.pace_paths(p, w, c, pressure, keys)[0].where("hours in (30.0, 31.0)").orderBy("hours").collect()
    assert fine[1]["score"] - fine[0]["score"] == pytest.approx((fine[0]["speed"] + fine[1]["speed"]) / 2, rel=0.02)


def test_cohort_paths_end_at_the_forecast_and_say_why_there_is_none(spark):
    p, _, c, pressure, keys = inputs(spark)
    old = spark.createDataFrame([(0, -END, -H, -H, "a"), (1, 0, END, END, "a")], "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")
    t = spark.createDataFrame([(0, -H, "a", 100, [0.3, 0.1, 0.1, 0.2, 0.2, 0.1], 1.0), (0, -H, "a", 1000, [0.1, 0.2, 0.3, 0.1, 0.1, 0.2], 1.0)], "contest_id long, end_at long, contest_type string, tier int, mass array<double>, pressure double")
    paths, bad = M.cohort_paths(p, t, old, pressure, keys)
    assert {r["tier"]: r["reason"] for r in bad.collect()} == {k: why for k, (_, why) in PREFIXES.items() if why}
    path = paths.orderBy("hours").collect()
    assert [r["hours"] for r in path] == [float(h) for h in range(24, 61)] and {r["tier"] for r in path} == {500}
    scores = [r["score"] for r in path]
    assert scores == sorted(scores) and scores[0] > 120
    # by hand: knots at 0, 6, 12, 18 and 20 h, the posterior over two templates of one contest
    import numpy as np

    full = lambda h: h + 0.3 / (2 * np.pi / 24) * (np.sin((h + 8 - 21) * 2 * np.pi / 24) - np.sin((8 - 21) * 2 * np.pi / 24))
    x = lambda h: full(h) / full(60.0)
    basis = lambda h: np.array([x(h)] + [(1 - np.exp(-x(h) / u)) / (1 - np.exp(-1 / u)) for u in (0.05, 0.2)] + [(np.exp((x(h) - 1) / u) - np.exp(-1 / u)) / (1 - np.exp(-1 / u)) for u in (0.03, 0.1, 0.3)])
    at = [0, 6, 12, 18, 20]
    share = np.diff(np.interp(at, [0, 10, 20], [0, 50, 120])) / 120
    mass = np.array([[0.3, 0.1, 0.1, 0.2, 0.2, 0.1], [0.1, 0.2, 0.3, 0.1, 0.1, 0.2]])
    curve = np.array([[basis(h) @ m for h in at] for m in mass])
    q = np.diff(curve, axis=1) / curve[:, -1:]
    prior = np.exp(-0.5 * (np.log(np.array([100, 1000]) / 500) / np.log(2)) ** 2)
    w = prior * np.exp(-16 * 20 / 24 * (share * np.log(share / q)).sum(1))
    at_hour = lambda h: 120 * (w * (mass @ basis(h)) / curve[:, -1]).sum() / w.sum()
    assert scores == pytest.approx([at_hour(h) for h in range(24, 61)], rel=1e-9)
    assert [r["speed"] for r in path] == pytest.approx([(at_hour(h + 1e-4) - at_hour(h - 1e-4)) / 2e-4 for h in range(24, 61)], rel=1e-5)
    none, why = M.cohort_paths(p.where("tier = 500"), t.where("false"), old, pressure)
    assert none.count() == 0 and [r["reason"] for r in why.collect()] == ["no_history"]
