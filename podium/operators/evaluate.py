"""Errors and their contest-equal means, coverage, paired comparisons, backtest plans and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.schema import HOUR_MS, K
from podium.session import cut

CELL = ["contest_id", "tier", "method"]


def error_metrics(scores: DataFrame) -> DataFrame:
    """error, abs_error, pct, ape (percent of the truth; null where it is 0) and smape (0 where both are 0)."""
    e = F.col("prediction") - F.col("actual")
    both = F.abs("prediction") + F.abs("actual")
    pct = F.when(F.col("actual") != 0, 100 * e / F.col("actual"))
    return scores.withColumns({"error": e, "abs_error": F.abs(e), "pct": pct, "ape": F.abs(pct), "smape": F.when(both == 0, 0.0).otherwise(200 * F.abs(e) / both)})


def hierarchical_metrics(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over origins in a cell, then over a contest's tiers, then over contests, all equal in weight; rmse per cell, then averaged.

    Rows: (method[, by], level, contest_id, tier, mape, mae, smape, bias, rmse, n) with level cell, contest or overall.
    """
    by = by or []
    ok = scores.where("status = 'success' and actual is not null")
    cell = ok.groupBy(*by, *CELL).agg(F.avg("ape").alias("mape"), F.avg("abs_error").alias("mae"), F.avg("smape").alias("smape"), F.avg("pct").alias("bias"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.count("*").alias("n"))
    up = lambda df, keys: df.groupBy(*by, *keys).agg(*[F.avg(c).alias(c) for c in ("mape", "mae", "smape", "bias", "rmse")], F.sum("n").alias("n"))
    contest = up(cell, ["contest_id", "method"])
    overall = up(contest, ["method"])
    tier = up(cell, ["tier", "method"])
    names = [*by, "method", "level", "contest_id", "tier", "mape", "mae", "smape", "bias", "rmse", "n"]
    fill = lambda df, level: df.select(*[F.lit(level).alias(c) if c == "level" else F.col(c) if c in df.columns else F.lit(None).cast("long" if c == "contest_id" else "int").alias(c) for c in names])
    return fill(cell, "cell").unionByName(fill(contest, "contest")).unionByName(fill(tier, "tier")).unionByName(fill(overall, "overall"))


def sliced_metrics(scores: DataFrame, dims: list[str]) -> DataFrame:
    """Overall hierarchical metrics of every slice of each dimension and of all rows: rows are replicated by slice before the first mean."""
    slices = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    r = scores.withColumn("s", F.explode(slices)).select("*", "s.dim", "s.value").drop("s")
    return hierarchical_metrics(r, ["dim", "value"]).where("level = 'overall'").drop("level", "contest_id", "tier")


def coverage_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(method, keys: scheduled, evaluable, attempted, success, failure, success_share, support, reasons)."""
    base = scores.withColumns({"ev": F.col("actual").isNotNull(), "won": F.col("status") == "success", "tried": F.col("status").isin("success", "failed")})
    g = base.groupBy("method", *keys).agg(F.count("*").alias("scheduled"), F.count_if("ev").alias("evaluable"), F.count_if(F.col("ev") & F.col("tried")).alias("attempted"), F.count_if(F.col("ev") & F.col("won")).alias("success"), F.count_if(F.col("ev") & F.col("tried") & ~F.col("won")).alias("failure"))
    why = base.where("not won and reason is not null").groupBy("method", *keys, "reason").agg(F.count("*").alias("n")).groupBy("method", *keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("reasons"))
    support = F.when(F.col("evaluable") == 0, "n.a.").when(F.col("success") == F.col("evaluable"), "complete").when(F.col("success") > 0, "partial").otherwise("unavailable")
    return g.join(why, ["method", *keys], "left").select("*", F.try_divide("success", "evaluable").alias("success_share"), support.alias("support"))


def paired_comparison(scores: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mape_a, mape_b, delta, wins_a, contests) on the rows where both succeeded; wins are contests of the smaller error."""
    d = contest_deltas(scores, a, b)
    return d.agg(F.avg("mape_a").alias("mape_a"), F.avg("mape_b").alias("mape_b"), F.avg("delta").alias("delta"), F.count_if(F.col("mape_a") < F.col("mape_b")).alias("wins_a"), F.count("*").alias("contests"))


def contest_deltas(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(contest_id, mape_a, mape_b, delta) on paired support: both methods' errors meet in one aggregation, without a self-join."""
    keys = [*K, "origin_h"]
    ok = scores.where(F.col("method").isin(a, b) & (F.col("status") == "success") & F.col("ape").isNotNull())
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("ape")))
    pair = ok.groupBy(*keys).agg(of(a).alias("x"), of(b).alias("y")).where("x is not null and y is not null")
    cell = pair.groupBy(*K).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return cell.groupBy("contest_id").agg(F.avg("x").alias("mape_a"), F.avg("y").alias("mape_b")).withColumn("delta", F.col("mape_b") - F.col("mape_a"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df with `i`, its place from 0 in the order of a column without repeats, and `n`, how many rows it has; ranges are numbered apart."""
    r = cut(df.repartitionByRange(column).withColumn("__p", F.spark_partition_id()))
    size = r.groupBy("__p").agg(F.count("*").alias("__c"))
    before = size.select("__p", F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)).alias("__b"), F.sum("__c").over(W.partitionBy()).alias("n"))  # a row a range
    own = F.row_number().over(W.partitionBy("__p").orderBy(column))
    return r.join(before, "__p").withColumn("i", F.coalesce("__b", F.lit(0)) + own - 1).drop("__p", "__b")


def bootstrap_ci(deltas: DataFrame, n: int = 2000, seed: int = 7) -> DataFrame:
    """(mean, lo, hi, draws): resampled means of contest deltas and their 2.5 and 97.5 % quantiles.

    Draws are hashes of (seed, replicate, draw); a replicate draws as many contests as there are.
    """
    known = numbered(deltas.select("contest_id", "delta"), "contest_id")
    draws = known.select("n", F.col("i").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    draws = draws.withColumn("i", F.floor(uniform(seed, F.col("rep"), F.col("draw")) * F.col("n")).cast("long"))
    means = draws.select("rep", "i").join(known.select("i", "delta"), "i").groupBy("rep").agg(F.avg("delta").alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.count("*").alias("draws"))


def snapshot_metrics(rows: DataFrame, curve_weight: float = 0.5) -> DataFrame:
    """One row over snapshots (prediction, actual, curve_mse): rel_mse, log_mse, rmse, mape, curve_mse, objective, n."""
    p, a = F.col("prediction"), F.col("actual")
    rel = (p - a) / F.greatest(a, F.lit(1.0))
    log = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(a, F.lit(0.0)))
    g = rows.agg(F.avg(rel * rel).alias("rel_mse"), F.avg(log * log).alias("log_mse"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"), F.avg(F.abs(rel)).alias("mape"), F.avg("curve_mse").alias("curve_mse"), F.count("*").alias("n"))
    return g.withColumn("objective", F.col("rel_mse") + curve_weight * F.coalesce("curve_mse", F.lit(0.0)))


def per_contest_summary(rows: DataFrame) -> DataFrame:
    """(contest_id, snapshots, mean_abs_rel, rel_mse, rmse, curve_mse), worst first."""
    rel = (F.col("prediction") - F.col("actual")) / F.greatest(F.col("actual"), F.lit(1.0))
    e = F.col("prediction") - F.col("actual")
    g = rows.groupBy("contest_id").agg(F.count("*").alias("snapshots"), F.avg(F.abs(rel)).alias("mean_abs_rel"), F.avg(rel * rel).alias("rel_mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("curve_mse").alias("curve_mse"))
    return g.orderBy(F.desc("rel_mse"), "contest_id")


def leaderboard(losses: DataFrame) -> DataFrame:
    """(config_id, train, holdout, rank) from (config_id, split, objective): by holdout loss, without one last."""
    g = losses.groupBy("config_id").agg(F.avg(F.when(F.col("split") == "train", F.col("objective"))).alias("train"), F.avg(F.when(F.col("split") == "holdout", F.col("objective"))).alias("holdout"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("holdout"), "config_id")))  # a row for each configuration


def deviation_stats(rows: DataFrame, newest: int | None = None) -> DataFrame:
    """One row (n, mean, max, min, std) of absolute errors; newest keeps the rows of so many newest contests."""
    if newest:
        ids = rows.select("contest_id").distinct().orderBy(F.desc("contest_id")).limit(newest)
        rows = rows.join(F.broadcast(ids), "contest_id", "left_semi")
    e = F.abs("error")
    return rows.agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.max(e).alias("max"), F.min(e).alias("min"), F.stddev_pop(e).alias("std"))


def coverage_gate(requested: DataFrame, included: DataFrame, min_contests: int, fraction: float) -> DataFrame:
    """One row (requested, included, required, share, passed, excluded)."""
    j = requested.select("contest_id").distinct().join(included.select("contest_id", F.lit(True).alias("ok")).distinct(), "contest_id", "left")
    g = j.agg(F.count("*").alias("requested"), F.count_if("ok").alias("included"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("contest_id").cast("string")))), ",").alias("excluded"))
    need = F.greatest(F.lit(min_contests), F.ceil(F.col("requested") * fraction)).cast("long")
    return g.select("requested", "included", need.alias("required"), F.try_divide("included", "requested").alias("share"), (F.col("included") >= need).alias("passed"), "excluded")


def time_split(contests: DataFrame, ratio: float = 0.75, min_test: int = 2) -> DataFrame:
    """contests with `split`: a tail in id order is the test; preferred are tails with all types, then sizes near 1 - ratio, then larger cuts."""
    w = W.orderBy("contest_id")  # one row a contest
    c = contests.select("contest_id", "contest_type").withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy())})
    tail = F.size(F.collect_set("contest_type").over(w.rowsBetween(0, W.unboundedFollowing)))
    every = F.size(F.collect_set("contest_type").over(W.partitionBy()))
    c = c.withColumns({"full": tail == every, "gap": F.abs((F.col("n") - F.col("i")) - F.greatest(F.lit(min_test), F.round(F.col("n") * (1 - ratio))))})
    at = c.where((F.col("i") > 0) & (F.col("n") - F.col("i") >= min_test)).orderBy(F.desc("full"), "gap", F.desc("i")).limit(1).select(F.col("i").alias("cut"))
    return c.join(F.broadcast(at), F.lit(True), "left").select("contest_id", "contest_type", F.when(F.col("i") >= F.col("cut"), "test").otherwise("train").alias("split"))


def id_split(contests: DataFrame, least: int, most: int, holdout: int) -> DataFrame:
    """train: least <= id <= most; holdout: id >= holdout; the others go."""
    s = F.when(F.col("contest_id") >= holdout, "holdout").when(F.col("contest_id").between(least, most), "train")
    return contests.withColumn("split", s).where("split is not null")


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of its arguments, joined by bars."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


#: Progress buckets of snapshots, and of curve checks in what remains.
BUCKETS = ((0.15, 0.25), (0.25, 0.40), (0.40, 0.55), (0.55, 0.70), (0.70, 0.85))
CURVE_BUCKETS = ((0.15, 0.35), (0.35, 0.60), (0.60, 0.85))


def _drawn(lo: Column, hi: Column, u: Column) -> Column:
    """A place between two, to a quarter of an hour but not beyond either."""
    return F.round(F.least(hi, F.greatest(lo, F.bround((lo + (hi - lo) * u) * 4, 0) / 4)), 4)


def snapshot_plan(contests: DataFrame, seed: int = 7, buckets: tuple = BUCKETS) -> DataFrame:
    """(contest_id, bucket, hour): a drawn hour of each progress bucket, from 18 h to nine tenths of the contest; empty buckets go.

    A contest without any has one snapshot (bucket -1) at its half, or at 18 h if that is later.
    """
    total = (F.col("end_at") - F.col("start_at")) / float(HOUR_MS)
    most = F.greatest(F.lit(18.0), 0.9 * F.col("total"))
    b = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(buckets)])
    cuts = F.transform(b, lambda x: F.struct(x["bucket"].alias("bucket"), F.greatest(F.lit(18.0), x["lo"] * F.col("total")).alias("lo"), F.least(x["hi"] * F.col("total"), most).alias("hi")))
    c = contests.select("contest_id", total.alias("total")).withColumn("b", F.filter(cuts, lambda x: x["hi"] > x["lo"]))
    half = F.least(most, F.greatest(F.lit(18.0), 0.5 * F.col("total")))
    none = F.array(F.struct(F.lit(-1).alias("bucket"), half.alias("lo"), half.alias("hi")))
    c = c.select("contest_id", F.explode(F.when(F.size("b") > 0, F.col("b")).otherwise(none)).alias("b")).select("contest_id", "b.*")
    hour = F.when(F.col("bucket") < 0, F.round("lo", 4)).otherwise(_drawn(F.col("lo"), F.col("hi"), uniform(seed, F.col("contest_id"), F.col("bucket"))))
    return c.select("contest_id", "bucket", hour.alias("hour")).groupBy("contest_id", "hour").agg(F.min("bucket").alias("bucket")).select("contest_id", "bucket", "hour")


def curve_check_hours(plan: DataFrame, contests: DataFrame, seed: int = 7, n: int = 3, buckets: tuple = CURVE_BUCKETS) -> DataFrame:
    """(contest_id, bucket, hour, check, check_hour): n drawn hours in buckets of what remains after each snapshot, in turn; none with an hour or less left."""
    j = plan.join(contests.select("contest_id", ((F.col("end_at") - F.col("start_at")) / float(HOUR_MS)).alias("total")), "contest_id").where("total > hour + 1")
    left = F.col("total") - F.col("hour")
    cuts = F.array(*[F.struct((F.col("hour") + F.greatest(F.lit(0.5), lo * left)).alias("lo"), F.least(F.col("total"), F.col("hour") + hi * left).alias("hi")) for lo, hi in buckets])
    j = j.withColumn("b", F.filter(cuts, lambda x: x["hi"] > x["lo"])).where("size(b) > 0").withColumn("check", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.get("b", F.pmod("check", F.size("b")))
    hour = _drawn(at["lo"], at["hi"], uniform(seed + 1, F.col("contest_id"), F.col("bucket"), F.col("check")))
    drawn = j.select("contest_id", "bucket", "hour", "check", hour.alias("check_hour"))
    return drawn.groupBy("contest_id", "bucket", "hour", "check_hour").agg(F.min("check").alias("check")).select("contest_id", "bucket", "hour", "check", "check_hour")


def scoring_row_checks(scores: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(check, contest_id, tier, origin_h): violations of what scoring rows promise; none in a sound table."""
    keys = [*K, "origin_h"]
    dup = scores.groupBy(*keys, "method").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("check"), *keys)
    lacks = scores.groupBy(*keys).agg(F.collect_set("method").alias("m")).where(F.size(F.array_except(F.array(*[F.lit(m) for m in methods]), F.col("m"))) > 0).select(F.lit("method_missing").alias("check"), *keys)
    odd = scores.where("(status <> 'success' and (prediction is not null or reason is null)) or (status = 'success' and prediction is null)").select(F.lit("status_mismatch").alias("check"), *keys)
    per = scores.groupBy(*K).agg(F.sort_array(F.collect_set("origin_h")).alias("o"))
    differ = per.groupBy("contest_id").agg(F.count_distinct("o").alias("n")).where("n > 1").select(F.lit("origins_differ").alias("check"), "contest_id", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("origin_h"))
    return dup.unionByName(lacks).unionByName(odd).unionByName(differ)


def screen_candidates(scores: DataFrame) -> DataFrame:
    """(method, mape, rows, planned, chosen): candidates by hierarchical MAPE over their own rows; of those that forecast every planned row the best is chosen, if there is one.

    Planned is every (contest, tier, origin) of scores that can be judged, its actual score being known and not 0. A
    candidate without a single forecast has no MAPE and 0 rows.
    """
    keys = [*K, "origin_h"]
    judged = scores.where("actual <> 0")
    planned = judged.select(*keys).distinct().agg(F.count("*").alias("planned"))
    ok = judged.where("status = 'success' and ape is not null")
    overall = hierarchical_metrics(ok).where("level = 'overall'").select("method", "mape")
    rows = ok.select("method", *keys).distinct().groupBy("method").agg(F.count("*").alias("rows"))
    out = scores.select("method").distinct().join(overall, "method", "left").join(rows, "method", "left").crossJoin(F.broadcast(planned))  # one row
    out = out.select("method", "mape", F.coalesce("rows", F.lit(0)).alias("rows"), "planned")
    full = F.when((F.col("rows") == F.col("planned")) & (F.col("planned") > 0), F.struct("mape", "method"))
    return out.withColumn("chosen", F.coalesce(full == F.min(full).over(W.partitionBy()), F.lit(False)))
