"""The bucketed store of live jobs: what is read, what is rewritten, and batches that are run again."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from podium.streaming import live as L
from podium.streaming import store as T

DDL = "contest_id long, tier int, time_ms long, score double, available_at long, seq long"


def batch(spark, seed, n=300, contests=40):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(contests), 10, rnd.randrange(20), float(rnd.randrange(5)), rnd.choice([None, rnd.randrange(50)]), seed * 1000 + i) for i in range(n)]
    return spark.createDataFrame([*rows, (1, 10, None, None, None, seed * 1000 + 999)], DDL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(at, part="data"):
    return {f for f in glob.glob(f"{at}/{part}/*/*/*.parquet")}


def test_latest_is_what_an_aggregate_over_all_batches_gives(spark, tmp_path):
    at, all_ = str(tmp_path), None
    for b in range(4):
        new = batch(spark, b)
        all_ = new if all_ is None else all_.unionByName(new)
        T.upsert_latest(spark, at, b, new, 8)
        T.upsert_latest(spark, at, b, new, 8)  # run again after its commit
        order = F.struct(F.col("available_at").isNotNull(), "available_at", "seq", "score")
        assert rows(T.latest(spark, at)) == rows(all_.groupBy("contest_id", "tier", "time_ms").agg(F.max_by("score", order).alias("score")))
    assert T.upsert_latest(spark, at, 2, batch(spark, 77), 8).batch == 3


def test_a_batch_that_failed_before_its_commit_is_run_again(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    T.upsert_latest(spark, at, 0, batch(spark, 0), 8)
    before = rows(T.latest(spark, at))
    with monkeypatch.context() as m:
        m.setattr(T, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            T.upsert_latest(spark, at, 1, batch(spark, 1), 8)
    assert rows(T.latest(spark, at)) == before
    T.upsert_latest(spark, at, 1, batch(spark, 1), 8)
    other = str(tmp_path / "other")
    for b in (0, 1):
        T.upsert_latest(spark, other, b, batch(spark, b), 8)
    assert rows(T.latest(spark, at)) == rows(T.latest(spark, other)) != before


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    at = str(tmp_path)
    T.upsert_latest(spark, at, 0, batch(spark, 0), 16)
    held = T.state(spark, at).held
    one = batch(spark, 5).where("contest_id = 7")
    bucket = one.select(T.bucket_of("contest_id", "tier", buckets=16)).first()[0]
    assert T.upsert_latest(spark, at, 1, one, 16).held == held | {bucket: 1}
    assert {os.path.basename(os.path.dirname(f)) for f in files(at) if "batch=1" in f} == {f"bucket={bucket}"}
    for b in (2, 3):
        T.upsert_latest(spark, at, b, one, 16)
    assert not glob.glob(f"{at}/data/batch=1") and sorted(os.listdir(f"{at}/commits")) == ["2", "3"]


def test_versions_are_those_of_a_merge_of_everything(spark, tmp_path):
    at, all_ = str(tmp_path), spark.createDataFrame([], DDL)
    for b in range(4):
        new = batch(spark, b % 3)
        all_ = L.merge_versions(all_, new, 100 + b).withColumn("seq", F.lit(0).cast("long"))
        T.add_versions(spark, at, b, new, 100 + b, 8, 64)  # few words, so the filter errs often
        assert rows(T.versions(spark, at)) == rows(all_.drop("seq"))


def test_a_fetch_that_brings_nothing_new_rewrites_nothing_and_opens_its_buckets_alone(spark, tmp_path):
    at = str(tmp_path)
    first = batch(spark, 0).withColumn("available_at", F.lit(5).cast("long"))
    T.add_versions(spark, at, 0, first, 5, 16)
    data, known = files(at), files(at, "known")
    again = first.where("contest_id in (3, 4)").withColumn("available_at", F.lit(9).cast("long"))
    assert set(T.add_versions(spark, at, 1, again, 9, 16).held.values()) == {0}
    assert files(at) == data and files(at, "known") == known
    bucket = T.bucket_of("contest_id", "tier", buckets=16)
    more = again.unionByName(spark.createDataFrame([(3, 10, 777, 1.0, None, 1)], DDL))
    mine, other = [spark.range(1).select(F.lit(c).cast("long").alias("contest_id"), F.lit(10).alias("tier")).select(bucket).first()[0] for c in (3, 4)]
    opened = T.read(spark, at, T._VERSIONS, [mine]).inputFiles()
    assert opened and all(f"/bucket={mine}/" in f for f in opened) and mine != other
    assert {k for k, b in T.add_versions(spark, at, 2, more, 11, 16).held.items() if b == 2} == {mine}
    assert {os.path.basename(os.path.dirname(f)) for p in ("data", "known") for f in files(at, p) if "batch=2" in f} == {f"bucket={mine}"}
    # the other buckets' files may be gone for good: nothing of them is opened
    for f in files(at):
        if f"bucket={mine}/" not in f and f"bucket={other}/" not in f:
            os.remove(f)
    T.add_versions(spark, at, 3, more.unionByName(spark.createDataFrame([(3, 10, 778, 1.0, None, 1)], DDL)), 12, 16)
    got = [r for r in T.read(spark, at, T._VERSIONS, [mine]).where("contest_id = 3 and time_ms > 700").collect()]
    assert sorted((r["time_ms"], r["available_at"]) for r in got) == [(777, 11), (778, 12)]


def test_an_empty_batch_is_a_commit(spark, tmp_path):
    none = spark.createDataFrame([], DDL)
    assert T.upsert_latest(spark, str(tmp_path), 0, none).batch == 0 and T.latest(spark, str(tmp_path)).count() == 0
    assert T.add_versions(spark, str(tmp_path / "v"), 0, none, 1).held == {} and T.versions(spark, str(tmp_path / "v")).count() == 0
