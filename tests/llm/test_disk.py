"""What a checkpoint leaves on the executors' disks."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from podium.llm.common import checkpoint


def test_checkpoints_leave_no_shuffle_files(spark):
    at = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {p for p in at.rglob("shuffle_*") if p.is_file()}
    before = files()
    kept = checkpoint(spark.range(50_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).repartition(3, "x").groupBy("x").count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.5)
    assert not files() - before
    assert kept.count() == 50_000 and kept.agg(F.sum("count")).first()[0] == 50_000
