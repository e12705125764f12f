"""Histories with ignored contests, prefixes at any origins, and candidates that lack forecasts."""

import random

import pytest
from pyspark.sql import functions as F

from podium.operators import evaluate as E
from podium.operators import joins as J
from podium.operators import series as S

H = 3_600_000


def contests(spark, n=20):
    return spark.createDataFrame([(i, "Medley" if i % 2 else "medley", i * 10, i * 10 + 5) for i in range(1, n + 1)], "contest_id long, contest_type string, start_at long, end_at long").withColumn("contest_type", F.lower("contest_type"))


@pytest.mark.parametrize("mode", ["offline", "online", "causal"])
def test_ignored_contests_take_no_place_among_the_newest(spark, mode):
    c = contests(spark)
    s = c.select("contest_id", F.lit(1.0).alias("scale"))
    got = J.select_history(c, s, 3, tuple(range(14, 20)), mode).where("target_id = 20").orderBy("rank").collect()
    assert [r["contest_id"] for r in got] == [13, 12, 11]


def test_causal_histories_with_ignored_contests_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(J, "NEAR", 5)
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), t := rnd.randrange(400), t + 50) for i in range(60)]
    c = spark.createDataFrame(rows, "contest_id long, contest_type string, start_at long, end_at long")
    s = spark.createDataFrame([(i, 0.0 if i % 4 == 0 else 1.0) for i in range(60)], "contest_id long, scale double")
    ignored = (3, 11, 12, 40, 41)
    want = []
    for i, kind, start, _ in rows:
        newest = [h for h in reversed(rows) if h[0] < i and h[1] == kind and h[0] not in ignored and h[3] < start][:5]
        want += [(i, h[0], k + 1) for k, h in enumerate([h for h in newest if h[0] % 4][:2])]
    assert sorted(tuple(r) for r in J.select_history(c, s, 2, ignored, "causal").collect()) == sorted(want)


@pytest.mark.parametrize("hours", [[24.0, 72.0], [18.25, 40.5, 60.0], [1.0, 2.0, 50.0]])
def test_prefix_totals_at_any_origins(spark, hours):
    obs = spark.createDataFrame([(1, t, k * H, float(k), k) for t in (10, 100) for k in range(73)] + [(2, 10, 5 * H, 7.0, 1)], "contest_id long, tier int, time_ms long, score double, seq long")
    origins = spark.createDataFrame([(1, h, int(h * H)) for h in hours] + [(2, 4.0, 4 * H), (2, 5.0, 5 * H)], "contest_id long, origin_h double, origin_ms long")
    got = {(r["contest_id"], r["tier"], r["origin_h"]): (r["rows"], r["last_score"], r["max_score"]) for r in S.prefix_totals(obs, origins).collect()}
    want = {}
    for h in hours:
        n = sum(k <= h for k in range(73))
        want |= {(1, t, h): (n, float(n - 1), float(n - 1)) for t in (10, 100)}
    assert got == want | {(2, 10, 5.0): (1, 7.0, 7.0)}


def test_a_candidate_without_full_coverage_is_not_chosen(spark):
    rows = [(1, 10, h, m, 100.0 + e, 100.0, "success") for h in range(8) for m, e in (("best", 1.0), ("good", 5.0), ("fair", 9.0)) if m != "best" or h > 5]
    rows += [(1, 10, h, "best", None, 100.0, "failed") for h in range(6)] + [(1, 10, 8, m, 1.0, 0.0, "success") for m in ("best", "good")] + [(1, 10, 0, "none", None, 100.0, "failed")]
    s = spark.createDataFrame(rows, "contest_id long, tier int, origin_h int, method string, prediction double, actual double, status string")
    got = {r["method"]: (r["rows"], r["planned"], r["chosen"]) for r in E.screen_candidates(E.error_metrics(s)).collect()}
    assert got == {"best": (2, 8, False), "good": (8, 8, True), "fair": (8, 8, False), "none": (0, 8, False)}
    partial = E.screen_candidates(E.error_metrics(s.where("method in ('best', 'none')")))
    assert [r["method"] for r in partial.where("chosen").collect()] == []
