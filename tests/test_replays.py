"""Backtests over all origins: a full grid with reasons, prefixes without later rows, planned snapshots."""

import os

import pytest
from pyspark.sql import functions as F

from podium.operators import evaluate as E
from podium.operators import series as S
from podium.plans import adapters as A
from podium.plans import model_queries as Q
from podium.plans import replays as R
from podium.schema import K

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_backtest_scores_every_origin_and_method(spark):
    b = Q.backtest(spark, SF).cache()
    c = A.contests(spark, SF)
    grid = A.obs(spark, SF).select(*K).distinct().join(S.daily_origins(c), "contest_id").count()
    assert b.count() == grid * len(R.METHODS) and {r[0] for r in b.select("origin_h").distinct().collect()} == {24.0, 48.0}
    assert E.scoring_row_checks(b, R.METHODS).count() == 0
    assert b.where("status = 'failed'").count() > 0 and {r[0] for r in b.where("status = 'failed'").select("reason").distinct().collect()} <= {"no_rows", "no_history", "no_forecast"}
    # contest 0 has no earlier contest to learn from, and says so
    assert {r[0] for r in b.where("contest_id = 0 and method = 'cohort'").select("reason").collect()} == {"no_history"}


def test_runs_see_their_prefix_only(spark):
    c = spark.createDataFrame([(3, 0, 360_000_000, 360_000_000, "a")], "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")
    o = spark.createDataFrame([(3, 18.25, 65_700_000), (3, 48.0, 172_800_000)], "contest_id long, origin_h double, origin_ms long")
    rows = spark.createDataFrame([(3, 50, h * 3_600_000, float(h)) for h in range(100)], "contest_id long, tier int, time_ms long, score double")
    seen = R.unrun(R.seen_by(rows, R.runs(c, o)))
    assert [tuple(r) for r in seen.groupBy("contest_id", "origin_h").agg(F.max("score")).orderBy("origin_h").collect()] == [(3, 18.25, 18.0), (3, 48.0, 48.0)]


def test_snapshots_follow_the_plan(spark):
    b = R.snapshots(spark, SF).cache()
    plan = E.snapshot_plan(A.contests(spark, SF)).select("contest_id", F.col("hour").alias("origin_h"))
    assert b.select("contest_id", "origin_h").distinct().exceptAll(plan).count() == 0 and plan.exceptAll(b.select("contest_id", "origin_h").distinct()).count() == 0
    assert b.where("status = 'success'").count() > 0 and b.where("status = 'success' and curve_mse is null").count() == 0
