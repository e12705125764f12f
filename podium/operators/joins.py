"""Histories, support sets, reward classes and sources: joins that pick what is comparable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.schema import K

#: Earlier contests of a type that a target looks through before it takes a join.
NEAR = 64


def select_history(contests: DataFrame, scales: DataFrame, k: int = 5, ignore: tuple = (297, 298), mode: str = "offline", targets: DataFrame | None = None) -> DataFrame:
    """(target_id, contest_id, rank): the k newest earlier contests of a target's type (case ignored).

    offline: of those with a positive scale; online: of the newest k + 3 those with a positive scale and the
    exact type; causal: as online, and ended before the target began. Only neighbours by id within a type
    can be chosen, so a window over each type does instead of a self-join. Ids are not chronological, so causal
    looks through NEAR of them; what a target does not find there is joined. Ignored ids are targets, but no
    histories: they take no place among the newest.
    """
    c = contests.withColumn("type_lc", F.lower("contest_type")).join(scales.select("contest_id", "scale"), "contest_id", "left")
    c = c.withColumns({"good": F.coalesce(F.col("scale") > 0, F.lit(False)) & ~F.col("contest_id").isin(*ignore), "taken": ~F.col("contest_id").isin(*ignore)})
    w = W.partitionBy("type_lc").orderBy("contest_id")
    if mode == "offline":
        # good contests of a type are numbered, and a target takes the k numbers before its own
        numbered = c.withColumn("g", F.coalesce(F.sum(F.col("good").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        good = numbered.where("good").select("type_lc", (F.col("g") + 1).alias("n"), F.col("contest_id").alias("h"))
        want = numbered.select("type_lc", F.col("contest_id").alias("target_id"), "g", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).withColumn("n", F.col("g") - F.col("rank") + 1).where("n >= 1")
        out = want.join(good, ["type_lc", "n"]).select("target_id", F.col("h").alias("contest_id"), "rank")
    else:
        near = (max(NEAR, k + 3) if mode == "causal" else k + 3) + len(ignore)  # room for ignored ones, which are left out of the list
        before = F.reverse(F.collect_list(F.when(F.col("taken"), F.struct("contest_id", "contest_type", "end_at", "good"))).over(w.rowsBetween(-near, -1)))
        c = c.withColumns({"before": before, "place": F.row_number().over(w)})
        if mode == "causal":
            c = c.withColumn("before", F.filter("before", lambda s: s["end_at"] < F.col("start_at")))
        c = c.withColumn("before", F.slice("before", 1, k + 3))
        fit = F.filter(F.col("before"), lambda s: s["good"] & (s["contest_type"] == F.col("contest_type")))
        found = (F.size("before") == k + 3) | (F.col("place") <= near + 1)
        out = c.where(found).select(F.col("contest_id").alias("target_id"), F.posexplode(F.slice(fit, 1, k)).alias("p", "s")).select("target_id", F.col("s.contest_id").alias("contest_id"), (F.col("p") + 1).alias("rank"))
        if mode == "causal":
            h = c.where("taken").select("type_lc", F.col("contest_id").alias("hid"), F.col("contest_type").alias("ht"), F.col("end_at").alias("he"), F.col("good").alias("hg"))
            p = c.where(~found).join(h, "type_lc").where("hid < contest_id and he < start_at").withColumn("r0", F.row_number().over(W.partitionBy("contest_id").orderBy(F.desc("hid")))).where(F.col("r0") <= k + 3)
            p = p.where("hg and ht = contest_type").withColumn("rank", F.row_number().over(W.partitionBy("contest_id").orderBy(F.desc("hid")))).where(F.col("rank") <= k)
            out = out.unionByName(p.select(F.col("contest_id").alias("target_id"), F.col("hid").alias("contest_id"), "rank"))
    return out if targets is None else out.join(targets.select(F.col("contest_id").alias("target_id")), "target_id", "left_semi")


def eligible_contests(contests: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Contests with at least k histories."""
    enough = history.groupBy("target_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    return contests.join(enough, contests["contest_id"] == enough["target_id"], "left_semi")


def missing_tiers(expected: DataFrame, obs: DataFrame) -> DataFrame:
    """(contest_id, tier, kind): cells expected but not observed (missing), and the other way round (unexpected)."""
    e, o = expected.select(*K).distinct(), obs.select(*K).distinct()
    return e.join(o, K, "left_anti").withColumn("kind", F.lit("missing")).unionByName(o.join(e, K, "left_anti").withColumn("kind", F.lit("unexpected")))


def paired_support(scores: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """Rows of method_a at (contest, tier, origin) where method_b succeeded."""
    keys = [*K, "origin_h"]
    b = scores.where((F.col("method") == method_b) & (F.col("status") == "success")).select(*keys)
    return scores.where(F.col("method") == method_a).join(b, keys, "left_semi")


def common_history(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(target_id, contest_id, rank): histories in both selections, intersected before the first k are taken."""
    both = a.select("target_id", "contest_id").intersect(b.select("target_id", "contest_id"))
    w = W.partitionBy("target_id").orderBy(F.desc("contest_id"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def map_reward_class(targets: DataFrame, classes: DataFrame, history: DataFrame) -> DataFrame:
    """(target_id, tier, reward_class, contest_id, mapped_tier): where in each history the reward class of a target's tier stands; tiers of several classes map nowhere."""
    c = classes.where("rank is not null")
    own = targets.select("target_id", "tier").join(c.select(F.col("contest_id").alias("target_id"), F.col("rank").alias("tier"), "reward_class"), ["target_id", "tier"])
    single = own.groupBy("target_id", "tier").agg(F.count("*").alias("n"), F.max("reward_class").alias("reward_class")).where("n = 1").drop("n")
    return single.join(history.select("target_id", "contest_id"), "target_id").join(c.select("contest_id", "reward_class", F.col("rank").alias("mapped_tier")), ["contest_id", "reward_class"]).select("target_id", "tier", "reward_class", "contest_id", "mapped_tier")


def route_source(obs: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """Rows of the first source of `priority` that is valid and not empty for a (contest, tier), with requested_source and fallback_used. A source with a bad value is not valid."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    per = obs.where(F.col("source").isin(*priority)).groupBy(*K, "source").agg(F.min((F.col("score") >= 0) & (F.col("time_ms") >= 0)).alias("valid")).where("valid")
    best = per.withColumn("r", F.row_number().over(W.partitionBy(*K).orderBy(order))).where("r = 1").select(*K, "source")
    return obs.join(best, [*K, "source"]).withColumns({"requested_source": F.lit(priority[0]), "fallback_used": F.col("source") != priority[0]})
