"""Queries read all rows of their inputs."""

from podium.plans import adapters as A
from podium.plans import aggregate_queries as Q
from podium.plans import model_queries as MQ
from podium.plans.series_queries import canonical
from podium.schema import K


def test_rewards_of_large_part_tables(spark, tmp_path):
    spark.range(19_990, 20_010).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert A.rewards(spark, str(tmp_path)).count() == 20


def test_reward_classes_of_every_reward_are_mapped(spark, monkeypatch):
    rewards = spark.createDataFrame([(c, "deco_pins", i, 50 * c) for c in (1, 2) for i in (4, 50)], "contest_id long, reward_type string, reward_id long, to_rank int")
    monkeypatch.setattr(A, "rewards", lambda spark, d: rewards)
    monkeypatch.setattr(Q, "history", lambda spark, d: spark.createDataFrame([(2, 1, 1)], "target_id long, contest_id long, rank int"))
    assert [tuple(r) for r in Q.j11(spark, "").collect()] == [(2, 100, "deco_pins", 1, 300)]


def test_pace_components_of_every_tier(spark):
    d = "/root/testdata/sf0.001"
    got = MQ.m1(spark, d).groupBy(*K).count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, canonical(spark, d).groupBy(*K).count().collect()))
