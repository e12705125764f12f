"""Growth curves from sums: no worse than searches over the series themselves, with the floor active and without it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.functions import numeric
from podium.operators import models as M

H = 3_600_000
T = 150.0
#: base, a, b, final rise, its length: two whose floor is active in between, one that is nowhere, one whose floor ends the rise's beginning
TRUTH = {50: (0.3, -0.009, 0.00006, 0.8, 30.0), 100: (0.05, -0.004, 0.00004, 0.5, 60.0), 500: (0.2, -0.001, 0.00001, 0.4, 22.0), 1000: (0.4, -0.005, 0.0, 2.0, 40.0)}


def curves(seed=3, n=300):
    r = np.random.default_rng(seed)
    t = np.sort(r.uniform(0, T, n))
    return t, {k: np.maximum(numeric.skeleton(t, np.array(p), T), 0) + np.abs(r.normal(0, 0.01, n)) for k, p in TRUTH.items()}


def test_stacked_box_least_squares_equals_single_ones():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(60, 30, 4)), r.normal(size=(60, 30)) * 3
    x[:20, :, 3] = 0
    g, b = np.einsum("mri,mrj->mij", x, x), np.einsum("mri,mr->mi", x, y)
    lo, hi = np.tile([-0.2, -1.0, 0.0, 0.0], (60, 1)), np.tile([0.2, 1.0, 0.3, 5.0], (60, 1))
    many = numeric.box_least_squares_many(g, b, lo, hi)
    one = np.stack([numeric.box_least_squares(*a) for a in zip(g, b, lo, hi, strict=True)])
    assert many == pytest.approx(one, abs=1e-9)


def test_fits_are_as_good_as_a_dense_search_where_the_floor_is_active(spark):
    t, ys = curves()
    assert (np.maximum(numeric.skeleton(t, np.array(TRUTH[50]), T), 0) == 0).sum() > 20
    rows = [(1, k, float(h), float(v)) for k, y in ys.items() for h, v in zip(t, y, strict=True)]
    rows += [(1, 2000, float(h), 1.0) for h in range(4)] + [(1, 50, None, None), (1, 50, 3.0, float("nan")), (1, 50, 3.0, float("inf"))]
    s = spark.createDataFrame(rows, "contest_id long, tier int, hours double, skeleton_speed double")
    c = spark.createDataFrame([(1, 0, int(T * H))], "contest_id long, start_at long, end_at long")
    got = {r["tier"]: r for r in M.fit_skeleton(s, c).collect()}
    assert got.keys() == TRUTH.keys()
    r = np.random.default_rng(5)
    for k, y in ys.items():
        p = np.array([got[k][x] for x in M.PARAMS])
        loss = lambda v, y=y: float(((y - np.maximum(numeric.skeleton(t, v, T), 0)) ** 2).mean())
        assert loss(p) == pytest.approx(got[k]["mse"], rel=1e-6)
        plain, at = numeric.fit_skeleton(t, y, T)
        assert loss(p) <= at * 1.001 and loss(p) <= loss(np.array(TRUTH[k])) * 1.001
        for start in (p, plain, np.array(TRUTH[k])):  # a random search from three places
            best, value = start, loss(start)
            for i in range(3000):
                v = best + r.normal(size=5) * np.array([0.05, 0.002, 0.00005, 0.1, 2.0]) * 10.0 ** -r.uniform(0, 3)
                v = np.clip(v, np.append(numeric.SKELETON_LOWER, 6.0), np.append(numeric.SKELETON_UPPER, 72.0))
                if (w := loss(v)) < value:
                    best, value = v, w
            assert loss(p) <= value * 1.01
    assert (numeric.SKELETON_LOWER <= p[:4]).all() and (p[:4] <= numeric.SKELETON_UPPER).all()


def test_refits_are_as_good_as_a_random_search_where_the_floor_is_active(spark):
    r = np.random.default_rng(4)
    hours = np.linspace(6, 54, 80)
    prior = {50: (0.30, -0.009, 0.00002), 100: (0.2, -0.006, 0.00001), 500: (0.3, 0.001, 0.00001)}
    rows, speeds = [], {}
    for k in prior:
        y = np.maximum(0.33 - (0.011 if k < 500 else -0.001) * hours, 0) + np.abs(r.normal(0, 0.01, 80))
        speeds[k] = y
        rows += [(1, k, float(h), float(v), float(v), 1.0) for h, v in zip(hours, y, strict=True)]
    rows += [(1, 1000, float(h), 0.1, 0.1, 1.0) for h in range(5)]
    prior[1000] = (0.5, -0.001, 0.0)
    p = spark.createDataFrame([(1, k, *v, 0.3, 20.0, 70.0) for k, v in prior.items()], "contest_id long, tier int, base double, a double, b double, b_end double, panic double, total_h double")
    w = spark.createDataFrame(rows, "contest_id long, tier int, hours double, norm_speed double, skeleton_speed double, conf double")
    got = {x["tier"]: np.array([x["base"], x["a"], x["b"]]) for x in M.refit_local(w, p).collect()}
    assert got.keys() == prior.keys() and got[1000] == pytest.approx(prior[1000])  # too few rows
    floored = 0
    for k, y in speeds.items():
        old = np.array(prior[k])
        q = np.log1p(y * 10)
        q, lam = q / q.mean(), 2 * 0.3 * ((y**2).mean() + 1e-6) / (old**2 + 1e-9)
        rise = 0.3 * numeric.rise(hours, 20.0, 70.0)
        curve = lambda x, rise=rise: x[0] + x[1] * hours + x[2] * hours**2 + rise
        loss = lambda x, q=q, y=y, lam=lam, old=old: (q * (np.maximum(curve(x), 0) - y) ** 2).mean() + (lam * (x - old) ** 2).sum()
        lo, hi = M._refit_bounds(old)
        assert (got[k] >= lo - 1e-12).all() and (got[k] <= hi + 1e-12).all()
        floored += (curve(got[k]) < 0).any()
        tries = [lo + (hi - lo) * r.random(3) for _ in range(2000)]
        tries += [np.clip(got[k] + (hi - lo) * r.normal(size=3) * 10.0 ** -r.uniform(1, 4), lo, hi) for _ in range(2000)]
        assert loss(got[k]) <= min(map(loss, tries)) + 1e-6 * loss(got[k])
    assert floored >= 1


def test_no_series_is_in_one_group(spark):
    s = spark.createDataFrame([(1, 50, float(h), 1.0) for h in range(20)], "contest_id long, tier int, hours double, skeleton_speed double")
    c = spark.createDataFrame([(1, 0, 60 * H)], "contest_id long, start_at long, end_at long")
    assert M.fit_skeleton(s.limit(0), c).count() == 0
    flat = M.fit_skeleton(s, c).select(*M.PARAMS, "mse").first()
    assert flat["base"] == pytest.approx(1.0) and flat["mse"] == pytest.approx(0, abs=1e-12)
    from podium.operators.curve_fit import _sums

    state = s.select("contest_id", "tier").distinct().withColumns({"total_h": F.lit(60.0), "low": F.lit(0.1), "lengths": F.array(F.lit(6.0)), "starts": F.array().cast("array<double>")})
    plan = _sums(s.withColumn("y", F.col("skeleton_speed")), state)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "partial_sum" in plan
