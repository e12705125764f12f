"""Configurations in one plan: the same forecasts as one by one, and a plan of one size."""

from pyspark.sql import functions as F

from podium.operators import models as M

H = 3_600_000
CONFIGS = [{"config_id": f"{s:g}/{same}/{move}", "strength": s, "same_type": same, "transfer": move} for s in (0.0, 4.0, 16.0) for same in (False, True) for move in (False, True)]


def inputs(spark):
    c = spark.createDataFrame([(k, k * 80 * H, k * 80 * H + 70 * H, k * 80 * H + 70 * H, "ab"[k % 2]) for k in range(5)], "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")
    places = c.select("contest_id", "start_at", "contest_type", F.explode(F.array(*[F.lit(h) for h in (0.0, 6.0, 12.0, 15.0)])).alias("hours"))
    k = M.mass_basis(places, c).withColumns({"tier": F.lit(500), "origin_h": F.lit(24), "i": (F.col("hours") / 6).cast("int") + (F.col("hours") == 15).cast("int")})
    k = k.withColumns({"share": F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.3, 0.2)]), F.col("i") + 1), "anchor_h": F.lit(15.0), "anchor": F.lit(90.0), "end_basis": F.array(*[F.lit(1.0)] * 6), "pressure": F.lit(0.7)})
    mass = F.array(*[F.lit(x) + 0.02 * (F.col("contest_id") % 3) * (1 if i % 2 else -1) for i, x in enumerate((0.2, 0.15, 0.15, 0.1, 0.2, 0.2))])
    t = c.select("contest_id", "end_at", "contest_type", F.explode(F.array(F.lit(100), F.lit(1000))).alias("tier"), mass.alias("mass")).withColumn("pressure", 0.3 + F.col("tier") / 4000)
    return k, t, c


def test_configurations_together_equal_one_by_one(spark):
    k, t, c = inputs(spark)
    cols = ["contest_id", "tier", "origin_h", F.round("final", 8), "templates", F.round("effective", 8)]
    got = {tuple(r) for r in M.forecast_cohort(k, t, c, configs=CONFIGS).select("config_id", *cols).collect()}
    want = set()
    for x in CONFIGS:
        own = M.forecast_cohort(k, t, c, strength=x["strength"], same_type=x["same_type"], transfer=x["transfer"])
        want |= {(x["config_id"], *r) for r in own.select(*cols).collect()}
    assert got == want and len({r[0] for r in got}) == len(CONFIGS)


def test_the_plan_does_not_grow_with_the_configurations(spark):
    k, t, c = inputs(spark)
    both = [x for x in CONFIGS if x["strength"] == 4.0]
    nodes = lambda df: df._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    assert nodes(M.forecast_cohort(k, t, c, configs=both)) == nodes(M.forecast_cohort(k, t, c, configs=CONFIGS * 10))
