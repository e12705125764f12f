"""Whitening against numpy, in exact whole numbers where the contract has them."""

import numpy as np
import pytest

from podium.llm import whitening

INF, NAN = float("inf"), float("nan")


def plain(rows, most=16, counted=False):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in usable], float) * 64).astype(object).astype(int) + 1_000_000
    u, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if counted else np.ones(len(u), int)
    n, s = int(w.sum()), (u * w[:, None]).sum(axis=0)
    c = u - s / n
    v = (c * w[:, None]).T @ c / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return usable, n, ((n * x - s) ** 2).sum(axis=1), ((x - s / n) @ vectors[:, order]) / np.sqrt(values[order]), values[order] / np.trace(v)


def rows_of(seed=1, n=400, d=20):
    rnd = np.random.default_rng(seed)
    base = [rnd.normal(size=d) * np.linspace(0.2, 2, d) for _ in range(n)]
    out = [(i, [float(c) for c in b]) for i, b in enumerate(base)]
    out += [(n + i, out[3][1]) for i in range(200)] + [(3, out[3][1]), (None, out[5][1])]
    return [*out, (9000, None), (9001, [None] * d), (9002, [NAN] * d), (9003, [INF] + [0.0] * (d - 1))]


@pytest.mark.parametrize("weight", ["one", "count"])
@pytest.mark.parametrize("d", [20, 5])
def test_whitening_equals_numpy(spark, weight, d):
    rows = rows_of(d=d)
    table = spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<double>, n int, X string").repartition(5)
    got = whitening.whiten(table, weight=weight).collect()
    usable, n, deviation, w, explained = plain(rows, counted=weight == "count")
    k = min(16, d)
    assert len(got) == k * len(usable)
    at = {}
    for (i, v), dev, own in zip(usable, deviation, w, strict=True):
        at.setdefault(i, []).append((tuple(v), int(dev), own))
    signs = {}
    for r in got:
        first = at[r["vec_id"]][0]
        assert r["n"] == n and r["deviation"] == first[1]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-10 and r["identity_error"] < 1e-8
        want = first[2][r["component"] - 1]
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
        if abs(want) > 0.1:
            signs.setdefault(r["component"], set()).add(np.sign(r["whitened"] * want))
    assert all(len(s) == 1 for s in signs.values())


def test_no_variance_lengths_and_large_entries(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["n"] == 1 and r["identity_error"] is None for r in same)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True} and all(r["identity_error"] < 1e-9 for r in flat)
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, [])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in ragged) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], schema)).collect()
    assert len(huge) == 6 and any(r["deviation"] is None for r in huge)
    x = [3_000_000.0, -3_000_000.0, 11.0]
    large = whitening.whiten(spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], schema)).collect()
    whole = [int(v * 64) + 1_000_000 for v in x]
    assert {r["vec_id"]: r["deviation"] for r in large} == {i: (3 * v - sum(whole)) ** 2 for i, v in enumerate(whole)}
