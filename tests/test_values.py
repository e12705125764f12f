"""Hand-checked values, no look-ahead, recovery of parameters, and streams against their batch twins."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from podium.functions import numeric
from podium.operators import aggregates as G
from podium.operators import clean as C
from podium.operators import evaluate as E
from podium.operators import joins as J
from podium.operators import models as M
from podium.operators import series as S
from podium.schema import DEFAULTS, violations
from podium.sources import readers as R
from podium.streaming import live as L

H = 3_600_000


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def obs(spark, rows):
    """rows: (contest, tier, time, score[, available, seq])"""
    return frame(spark, [(c, t, m, float(s), *(r or [None]), i) for i, (c, t, m, s, *r) in enumerate(rows)], "contest_id long, tier int, time_ms long, score double, available_at long, seq long")


def contest(spark, start=0, end=4 * H, cid=1, kind="a"):
    return frame(spark, [(cid, start, end, end, kind)], "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")


def test_scales(spark):
    ddl = "contest_id long, uid long, time_ms long, value double, seq long"
    p = frame(spark, [(1, 1, 0, 0.0, 0), (1, 1, H, 6000.0, 1), (1, 1, 2 * H, 606000.0, 2)], ddl)
    o = frame(spark, [(1, H)], "contest_id long, origin_ms long")
    assert G.scale_from_points(p, o).first()["scale"] == 100.0
    three = frame(spark, [(1, u, t, v if t else 0.0, u) for u, v in ((1, 6000.0), (2, 6200.0), (3, 6100.0)) for t in (0, H)], ddl)
    assert G.scale_from_points(three).first()["scale"] == pytest.approx(18300 / 180)


def test_quality_report_counts(spark):
    o = frame(spark, [(1, 10, t, float(s), a, i) for i, (t, s, a) in enumerate([(0, 100, 0), (H, 130, H), (H, 120, H), (3 * H // 2, 110, 3 * H // 2), (2 * H, 140, 3 * H)])], "contest_id long, tier int, time_ms long, score double, available_at long, seq long")
    r = G.tier_quality_report(o, frame(spark, [(1, 2 * H)], "contest_id long, origin_ms long"), frame(spark, [(10,), (20,)], "tier int"))
    got = {x["tier"]: x for x in r.collect()}
    assert (got[10]["duplicate_rows"], got[10]["falls"], got[10]["future_available"], got[20]["status"]) == (2, 1, 1, "missing")
    assert G.quality_rollup(r).first()["completeness"] == 0.5


def test_latest_revision_is_order_free(spark):
    for rows in ([(1, 10, 50, 200, 90), (1, 10, 50, 100, 80)], [(1, 10, 50, 100, 80), (1, 10, 50, 200, 90)]):
        assert S.latest_revision(obs(spark, rows)).first()["score"] == 200


def test_interpolated_tier(spark):
    rows = [(1, 1000, 0, 10e6), (1, 1000, H, 12e6), (1, 2000, 0, 4e6), (1, 2000, H, 6e6)]
    got = sorted(r["score"] for r in S.interpolate_tier_asof(obs(spark, rows), 1500, 1000, 2000).collect())
    w = math.log(1.5) / math.log(2)
    assert got == pytest.approx([10e6 * (1 - w) + 4e6 * w, 12e6 * (1 - w) + 6e6 * w])


def test_rewards(spark):
    r = frame(spark, [(1, "voice_stamp", 10118, 500), (1, "voice_stamp", 519, 1500), (1, "deco_pins", 103210, 2000), (1, "degree", 1, 10), (1, "star", None, 20)], "contest_id long, reward_type string, reward_id long, to_rank int")
    assert G.special_reward_tiers(r).first()["targets"] == [500, 1500, 2000]
    assert {(x["reward_class"], x["rank"]) for x in G.reward_class_ranks(r).collect()} == {("premium", 500), ("standard", 1500), ("deco_pins", 2000)}


def test_tiers(spark):
    d = frame(spark, [(x,) for x in ("999", "true", "10.9", "010", "10.0", "1000", "10", "5000")], "tier string")
    kept, rest = C.validate_tiers(d)
    assert {r[0] for r in kept.collect()} == {"1000", "10", "5000"} and rest.count() == 5


def test_training_series_maps_the_end(spark):
    rows = [(1, 500, H, 10), (1, 500, 2 * H, 20), (1, 500, 4 * H + 60_000, 31), (1, 500, 4 * H + 15 * 60_000, 7)]
    s = S.canonical_training_series(obs(spark, rows), contest(spark))
    assert sorted((r["hours"], r["score"]) for r in s.collect()) == [(0, 0), (1, 10), (2, 20), (4, 31)]
    d = S.training_diagnostics(obs(spark, rows), contest(spark)).first()
    assert (d["mapped"], d["disagreements"], d["delay_ms"]) == (True, 1, 60_000)
    fixed = S.canonical_training_series(obs(spark, [(1, 500, H, 10), (1, 500, 2 * H, 8), (1, 500, 4 * H, 12)]), contest(spark))
    assert [r["score"] for r in fixed.orderBy("hours").collect()] == [0, 10, 10, 12]


def test_prefixes_do_not_look_ahead(spark):
    rows = [(1, 500, k * H, 10 * k) for k in range(1, 60)]
    poisoned = [(c, t, m, s if m <= 24 * H else -1e9) for c, t, m, s in rows]
    o = S.daily_origins(contest(spark, end=60 * H)).where("origin_h = 24")
    of = lambda x: [tuple(r) for r in S.baseline_forecasts(S.prefix_join(obs(spark, x), o), contest(spark, end=60 * H)).collect()]
    assert of(rows) == of(poisoned) and of(rows)[0][3:] == (240.0, 600.0, 600.0)


def test_hierarchical_means(spark):
    rows = [(1, 500, h, 10.0) for h in range(10)] + [(1, 1500, 0, 30.0), (2, 500, 0, 50.0)]
    s = frame(spark, [(c, t, h, "m", "success", 100.0 + e, 100.0) for c, t, h, e in rows], "contest_id long, tier int, origin_h int, method string, status string, prediction double, actual double")
    m = E.hierarchical_metrics(E.error_metrics(s))
    assert m.where("level = 'overall'").first()["mape"] == pytest.approx(35)
    e = E.error_metrics(frame(spark, [(110.0, 100.0)], "prediction double, actual double")).first()
    assert (e["pct"], e["ape"], e["smape"]) == pytest.approx((10, 10, 2000 / 210))


def test_history_selection(spark):
    c = frame(spark, [(i, "A", i * 10, i * 10 + 5) for i in range(296, 302)], "contest_id long, contest_type string, start_at long, end_at long")
    s = frame(spark, [(i, 1.0) for i in range(296, 302)], "contest_id long, scale double")
    got = {r["rank"]: r["contest_id"] for r in J.select_history(c, s, 3).where("target_id = 301").collect()}
    assert got == {1: 300, 2: 299, 3: 296}


def test_splits_gates_and_means(spark):
    c = frame(spark, [(i, t) for i, t in zip(range(201, 209), "ababcabc", strict=True)], "contest_id long, contest_type string")
    assert {r["contest_id"] for r in E.time_split(c).where("split = 'test'").collect()} == {206, 207, 208}
    g = E.coverage_gate(c.where("contest_id < 204"), c.where("contest_id < 203"), 2, 0.6).first()
    assert (g["required"], g["passed"]) == (2, True) and g["share"] == pytest.approx(2 / 3)
    w = M.event_equal_mean(frame(spark, [(0.2, 0.3, 0.5), (0.4, 0.1, 0.5)], "a double, b double, c double"), ["a", "b", "c"]).first()
    assert tuple(w)[:3] == pytest.approx((0.3, 0.2, 0.5))


def test_window_mapping(spark):
    p = frame(spark, [(1, 226.0, 2, 178.0, 500, 35.0, 109.75)], "target_id long, target_hours double, contest_id long, history_hours double, tier int, t0 double, t1 double")
    r = p.select(G.duration_weight(F.col("target_hours"), F.col("history_hours"), 0.75).alias("a"), G.duration_weight(F.col("history_hours"), F.col("target_hours"), 0.75).alias("b"), G.duration_weight(F.lit(5.0), F.lit(5.0), 0.75).alias("z")).first()
    assert r["a"] == r["b"] == 0.75 and r["z"] == 0


def test_numeric_helpers():
    t = np.array([10.0, 50.0, 100.0])
    x = np.linspace(0, 1, 400_001)
    for v, got in zip(t, numeric.urgency_integral(t, np.full(3, 100.0), np.full(3, 7.0)), strict=True):
        s = x * v
        f = (1 + 0.3 * np.cos(2 * np.pi * (s + 7 - 21) / 24)) * (0.08 / ((100 - s) / 100 + 0.08)) ** 1.6
        assert got == pytest.approx(np.trapezoid(f, s), rel=1e-7)
    r = np.random.default_rng(1)
    a = r.normal(size=(50, 4))
    truth = np.array([0.5, 0.0, 0.3, 0.2])
    assert numeric.simplex_least_squares(a.T @ a, a.T @ (a @ truth)) == pytest.approx(truth, abs=1e-8)
    y = a @ np.array([2.0, -3.0, 0.1, 0.0])
    b = numeric.box_least_squares(a.T @ a, a.T @ y, np.full(4, -1.0), np.full(4, 1.0))
    loss = lambda p: ((y - a @ p) ** 2).sum()
    assert all(loss(b) <= loss(np.clip(b + 0.05 * r.normal(size=4), -1, 1)) + 1e-9 for _ in range(300))
    p = np.array([0.2, -0.001, 0.00001, 0.4, 22.0])
    h = np.linspace(0, 150, 400)
    got, mse = numeric.fit_skeleton(h, np.maximum(numeric.skeleton(h, p, 150.0), 0), 150.0)
    assert mse < 1e-5


def test_pace_weights_are_recovered(spark):
    c = contest(spark, end=100 * H)
    tiers = frame(spark, [(1, t) for t in (100, 500, 1000)], "contest_id long, tier int")
    pr = M.reward_pressure(frame(spark, [(1, 500)], "contest_id long, tier int"), tiers)
    pts = tiers.crossJoin(spark.range(0, 35).select((F.col("id") * 100 / 34.0).alias("hours")))
    s = M.pace_components(pts, c, pr).select("contest_id", "tier", "hours", (F.col("tier") * (0.34 * F.col("c1") + 0.41 * F.col("c2") + 0.25 * F.col("c3"))).alias("score"))
    f = M.fit_pace_weights(s, c, pr).first()
    assert (f["w1"], f["w2"], f["w3"]) == pytest.approx((0.34, 0.41, 0.25), abs=2e-4) and f["loss"] < 1e-8


def test_cohort_masses_are_recovered(spark):
    c = contest(spark, end=100 * H)
    pts = frame(spark, [(1, 500, h * 2.0) for h in range(51)], "contest_id long, tier int, hours double")
    truth = [0.3, 0.0, 0.2, 0.0, 0.1, 0.4]
    s = M.mass_basis(pts, c).withColumn("score", 1e6 * sum(F.col("basis")[i] * m for i, m in enumerate(truth)))
    f = M.fit_cohort_mass(s, c).first()
    assert f["mass"] == pytest.approx(truth, abs=1e-5) and f["rmse"] < 1e-6


def test_kalman_fold_equals_its_stream_state(spark):
    steps = [(1, 500, k, 60.0 + 3 * (k % 5), 40.0 + 2 * k) for k in range(40)]
    d = frame(spark, steps, "contest_id long, tier int, step int, delta double, model double")
    want = M.kalman_strength(d).first()

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            assert at == 99 * H + 20 * 60_000

    p = L.Strength()
    p.init(Handle())
    pdf = pd.DataFrame(steps, columns=["contest_id", "tier", "step", "delta", "model"]).assign(end_at=99 * H, ts=pd.to_datetime(0))
    for k in range(0, 40, 7):
        out = list(p.handleInputRows((1, 500), iter([pdf[k : k + 7]]), None))[0]
    assert out["scale"][0] == pytest.approx(want["scale"], rel=1e-12) and out["trend"][0] == pytest.approx(want["trend"], rel=1e-12)


def test_versions_and_streams(spark, tmp_path):
    old = L.merge_versions(frame(spark, [], "contest_id long, tier int, time_ms long, score double, available_at long"), frame(spark, [(1, 10, 1, 100.0), (1, 10, 2, 120.0)], "contest_id long, tier int, time_ms long, score double"), 5)
    new = L.merge_versions(old, frame(spark, [(1, 10, 2, 125.0), (1, 10, 3, 150.0), (1, 10, 1, 100.0)], "contest_id long, tier int, time_ms long, score double"), 9)
    assert sorted((r["time_ms"], r["score"], r["available_at"]) for r in new.collect()) == [(1, 100, 5), (2, 120, 5), (2, 125, 9), (3, 150, 9)]
    assert sorted(r["score"] for r in L.latest_view(new.withColumn("seq", F.lit(0))).collect()) == [100, 125, 150]
    rows = [(1, 10, k * H, float(k * k), k * H, k) for k in range(1, 31)]
    base = frame(spark, rows, "contest_id long, tier int, time_ms long, score double, available_at long, seq long").withColumn("ts", F.timestamp_millis("time_ms"))
    base.repartitionByRange(3, "time_ms").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {r["window"]["start"]: r["gain"] for r in run(L.live_speed_windows(src), "complete", "gains").collect()}
    batch = {r["window"]["start"]: r["gain"] for r in L.live_speed_windows(base).collect()}
    assert got == batch and len(batch) == 6
    ok, late = L.late_policy(src, contest(spark, end=20 * H))
    assert run(ok, "append", "ok").count() == 20 and run(late, "append", "late").count() == 10
    assert run(L.first_seen_versions(src, "40 hours"), "append", "seen").count() == 30


def test_readers_round_trip(spark, tmp_path):
    index = {"success": True, "data": {"318": {"eventType": "x", "startAt": ["1", None, 3], "endAt": ["2", None, "4"], "aggregateEndAt": [None, None, "5"]}}}
    (tmp_path / "index.json").write_text(json.dumps(index))
    got = {(r["contest_id"], r["server"]): (r["start_at"], r["end_at"], r["aggregate_at"]) for r in R.read_contest_index(spark, str(tmp_path / "index.json")).collect()}
    assert got[318, 0] == (1, 2, 2) and got[318, 2] == (3, 4, 5) and got[318, 1] == (None, None, None)
    listed = {"data": {"events": [{"eventId": 7, "eventType": "y", "timeline": {"cn": {"startAt": "10", "endAt": "20"}}}]}}
    (tmp_path / "list.json").write_text(json.dumps(listed))
    r = R.read_contest_index(spark, str(tmp_path / "list.json")).first()
    assert (r["contest_id"], r["server"], r["start_at"]) == (7, 3, 10)
    cache = {"event_id": 9, "meta": {"start_at": 0, "end_at": 4 * H, "event_type": "x"}, "reward_tiers": [500], "reward_tier_provenance": {"last_appearance": {"a:1": 500}}, "tier_records": {"500": [{"time": 1, "ep": 10}, {"time": 2, "ep": 20}]}}
    (tmp_path / "c.json").write_text(json.dumps(cache))
    contests, rows, rewards, _ = R.read_contest_cache(spark, str(tmp_path / "c.json"))
    assert contests.first()["end_at"] == 4 * H and [x["score"] for x in rows.orderBy("seq").collect()] == [10, 20] and rewards.first()["reward_tiers"] == [500]
    (tmp_path / "good.json").write_text('{"result": true, "cutoffs": [{"time": 1, "ep": 5}]}')
    (tmp_path / "bad.json").write_text('{"result": false, "cutoffs": []}')
    ok, bad = R.read_tracker_payload(spark, str(tmp_path / "[gb]*d.json"))
    assert ok.first()["score"] == 5 and bad.first()["reason"] == "result_not_true"
    (tmp_path / "p.json").write_text('{"points": [{"uid": 1, "time": 0, "value": 3}]}')
    assert R.read_player_points(spark, str(tmp_path / "p.json"))[0].first()["value"] == 3
    (tmp_path / "r.json").write_text('{"eventId": 3, "rankingRewards": [[], [{"toRank": 500, "rewardType": "deco_pins", "rewardId": 7}]]}')
    assert R.read_rewards(spark, str(tmp_path / "r.json"), 1)[0].first()["to_rank"] == 500 and R.read_rewards(spark, str(tmp_path / "r.json"), 0)[1].count() == 1
    (tmp_path / "preset.json").write_text('{"_meta": {}, "params": {"ratio_min": 0.5, "note": "x"}}')
    p = R.read_presets(spark, str(tmp_path / "preset.json")).first()["params"]
    assert p["ratio_min"] == 0.5 and p["ratio_max"] == 4.0
    learned = {"weekend_multiplier": 1.13, "smooth_thresh1": 0.4, "refit_start_hours": 5.0, "kf_adaptive_R_numerator": 4068.0, "kf_trend_half_life_hours": 1.02, "duration_align_log_full_weight": 0.08, "scale_max": 2.0}
    (tmp_path / "learned.json").write_text(json.dumps({"params": learned}))
    config = R.preset(spark, str(tmp_path / "learned.json"))
    assert all(config[k] == v for k, v in learned.items()) and config["kf_scale_clip_max"] == 3.0 and config["smooth_thresh2"] == 0.65 and not violations(config)
    assert len(violations(config | {"smooth_thresh1": 0.9, "kf_base_R": 0.0, "ratio_min": 9.0})) == 3
    prof = frame(spark, [("weekday", h, 0.5, 0.4, 0.1, 3 if h else 0) for h in range(24)], "day_type string, hour int, mean double, median double, std double, cnt long")
    R.write_hour_profile(prof, str(tmp_path / "prof"))
    back = R.read_hour_profile(spark, str(tmp_path / "prof"))
    assert back.count() == 24 and back.where("cnt = 3").count() == 23
    o = obs(spark, [(1, 500, 1, 1), (70, 500, 1, 2)])
    R.write_observations(o, str(tmp_path / "obs"))
    R.write_observations(o.where("contest_id = 1").withColumn("score", F.lit(9.0)), str(tmp_path / "obs"))
    assert sorted(r["score"] for r in spark.read.parquet(str(tmp_path / "obs")).collect()) == [2, 9]


def test_rejected_prefixes_say_why(spark):
    c = contest(spark, end=40 * H)
    o = S.daily_origins(c).withColumn("origin_ms", F.col("origin_ms"))
    bad = obs(spark, [(1, 500, H, 10), (1, 500, 2 * H, 5), (1, 1000, H, 1), (1, 1000, H, 2), (1, 50, H, 0), (1, 100, H, 3)])
    p = S.prefix_join(bad, o).join(c.select("contest_id", "start_at", "end_at"), "contest_id")
    got = {r["tier"]: r["reason"] for r in C.prefix_gate(p).collect()}
    assert got == {500: "decreasing_score", 1000: "duplicate_time", 50: "no_score", 100: None}


def test_quality_report_keeps_origins_apart(spark):
    o = frame(spark, [(1, 10, t * H, float(t), t * H, t) for t in range(5)], "contest_id long, tier int, time_ms long, score double, available_at long, seq long")
    at, tiers = frame(spark, [(1, 2 * H), (1, 9 * H)], "contest_id long, origin_ms long"), frame(spark, [(10,), (20,)], "tier int")
    got = {(r["origin_ms"], r["tier"]): r for r in G.tier_quality_report(o, at, tiers).collect()}
    assert [(got[m, 10][c]) for m in (2 * H, 9 * H) for c in ("raw_rows", "usable", "post_origin", "duplicate_rows")] == [5, 3, 2, 0, 5, 5, 0, 0]
    assert got[2 * H, 20]["status"] == "missing" and got[9 * H, 10]["availability"] == "explicit_row_level"
    late = o.drop("available_at").withColumn("response_at", F.lit(3 * H))
    said = {r["origin_ms"]: (r["usable"], r["future_available"], r["availability"]) for r in G.tier_quality_report(late, at, tiers.where("tier = 10")).collect()}
    assert said == {2 * H: (0, 3, "explicit_response_level"), 9 * H: (5, 0, "explicit_response_level")}
    bare = G.tier_quality_report(o.drop("available_at"), at, tiers.where("tier = 10")).collect()
    assert {r["availability"] for r in bare} == {"unknown_degraded_timestamp_only"} and [r["usable"] for r in sorted(bare, key=lambda r: r["origin_ms"])] == [3, 5]
    odd = o.withColumn("score", F.lit(None).cast("double"))
    assert {r["status"] for r in G.tier_quality_report(odd, at, tiers.where("tier = 10")).collect()} == {"invalid_schema"}
    partial = o.withColumn("available_at", F.when(F.col("seq") != 1, F.col("available_at")))
    r = G.quality_rollup(G.tier_quality_report(partial, at, tiers)).orderBy("origin_ms").collect()
    assert [(x["usable"], x["missing"], x["availability"]) for x in r] == [(2, [20], "degraded_timestamp_only"), (4, [20], "degraded_timestamp_only")]


def test_scales_of_two_origins(spark):
    p = frame(spark, [(1, 1, t * H, 600.0 * t * t, t) for t in range(4)], "contest_id long, uid long, time_ms long, value double, seq long")
    o = frame(spark, [(1, H), (1, 3 * H)], "contest_id long, origin_ms long")
    assert {r["origin_ms"]: r["scale"] for r in G.scale_from_points(p, o).collect()} == pytest.approx({H: 10.0, 3 * H: 30.0})


def test_causal_history_beyond_the_frame(spark, monkeypatch):
    """Ids against time: what the nearest ids lack is found by the join."""
    monkeypatch.setattr(J, "NEAR", 6)
    r = random.Random(8)
    rows = []
    for i in range(60):
        start = r.randint(0, 50) * H
        rows.append((i, start, start + 4 * H, start + 4 * H, r.choice("ab")))
    c = frame(spark, rows, "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")
    s = frame(spark, [(i, 1.0) for i in range(60) if i % 4], "contest_id long, scale double")
    want = []
    for i, start, _, _, kind in rows:
        near = [h for h in reversed(rows) if h[0] < i and h[4] == kind and h[2] < start][:5]
        want += [(i, h[0], k + 1) for k, h in enumerate([h for h in near if h[0] % 4][:2])]
    assert sorted(tuple(x) for x in J.select_history(c, s, 2, (), "causal").collect()) == sorted(want) and want


def test_plans_of_short_and_long_contests(spark):
    c = frame(spark, [(k, 0, h * H, h * H, "a") for k, h in enumerate((10, 20, 30, 226))], "contest_id long, start_at long, end_at long, aggregate_at long, contest_type string")
    plan = E.snapshot_plan(c)
    got = {}
    for r in plan.collect():
        got.setdefault(r["contest_id"], []).append((r["bucket"], r["hour"]))
    assert got[0] == [(-1, 18.0)] and got[1] == [(-1, 18.0)] and len(got[3]) == 5
    assert all(18 <= h <= max(18.0, 0.9 * 30) for _, h in got[2]) and all(b >= 3 for b, _ in got[2])
    for b, h in got[3]:
        lo, hi = E.BUCKETS[b]
        assert lo * 226 - 1e-4 <= h <= hi * 226 + 1e-4
    checks = E.curve_check_hours(plan.where("contest_id = 3"), c).collect()
    assert len(checks) == 15 and all(r["hour"] < r["check_hour"] <= 226 for r in checks)


def test_no_plan_has_nested_loops_over_rows(spark):
    """What models join is joined by keys, or one side is a row."""
    d = "/root/testdata/sf0.001"
    from podium.plans import aggregate_queries as Q
    from podium.plans import model_queries as MQ

    for f in (MQ.m8_fixed, MQ.m19, Q.j1_causal):
        plan = f(spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_last_rows_are_all_that_baselines_need(spark):
    r = random.Random(2)
    o = obs(spark, [(c, t, r.randint(0, 90) * H // 2, r.randint(0, 500)) for c in (1, 2) for t in (50, 500) for _ in range(60)])
    c = contest(spark, end=40 * H, cid=1).unionByName(contest(spark, start=2 * H, end=45 * H, cid=2))
    at = S.daily_origins(c, 6)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.baseline_forecasts(S.prefix_join(S.last_rows(o, at), at), c)) == key(S.baseline_forecasts(S.prefix_join(o, at), c))


def test_local_refit_is_a_least_squares_in_a_box(spark):
    """Against random places in the box: none has a smaller loss."""
    r = np.random.default_rng(5)
    p = {"base": 0.4, "a": -0.002, "b": 1e-5, "b_end": 0.2, "panic": 20.0}
    hours = np.linspace(6, 50, 60)
    speed = 0.3 + 0.004 * hours + r.normal(0, 0.02, 60)
    prior = frame(spark, [(1, 50, *p.values(), 70.0)], "contest_id long, tier int, base double, a double, b double, b_end double, panic double, total_h double")
    window = frame(spark, [(1, 50, float(h), float(s), float(s), 1.0) for h, s in zip(hours, speed, strict=True)], "contest_id long, tier int, hours double, norm_speed double, skeleton_speed double, conf double")
    got = M.refit_local(window, prior).first()
    q = np.log1p(speed * 10)
    q = q / q.mean()
    lam = 2 * 0.3 * ((speed**2).mean() + 1e-6)
    old = np.array([p["base"], p["a"], p["b"]])
    design = np.stack([np.ones(60), hours, hours**2])
    loss = lambda x: (q * (x @ design - speed) ** 2).mean() + lam * (((x - old) ** 2) / (old**2 + 1e-9)).sum()
    lo, hi = M._refit_bounds(old)
    best = np.array([got["base"], got["a"], got["b"]])
    assert (best >= lo - 1e-12).all() and (best <= hi + 1e-12).all()
    assert all(loss(lo + (hi - lo) * r.random(3)) >= loss(best) - 1e-12 for _ in range(3000)) and loss(best) < loss(old)


def test_a_preset_changes_a_forecast(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    from podium.plans import model_queries as MQ

    (tmp_path / "p.json").write_text(json.dumps({"params": {"smooth_hard_cap": 0.66, "panic_scaler": 2.0, "kf_scale_clip_max": 0.6}}))
    args = MQ.fixed_params(spark, d).drop("start_at", "total_h").where("tier = 500"), MQ.canonical(spark, d).where("hours <= 48"), MQ.A.contests(spark, d), MQ.scales(spark, d), MQ.factors(spark, d)
    plain, own = ({r["contest_id"]: r["final"] for r in M.forecast_skeleton(*args, config).collect()} for config in (DEFAULTS, R.preset(spark, str(tmp_path / "p.json"))))
    assert plain.keys() == own.keys() and sum(plain[k] != own[k] for k in plain) >= 5


def test_forecasts_go_on_from_the_last_assumed_point(spark):
    seen = M.with_path(frame(spark, [(1, 50, 10.0, 100.0)], "contest_id long, tier int, hours double, score double"), frame(spark, [(1, 50, 14.0, 150.0, True)], "contest_id long, tier int, hours double, score double, is_manual boolean"))
    c, flat = contest(spark, end=40 * H), frame(spark, [(t, h, 1.0) for t in ("weekday", "weekend") for h in range(24)], "day_type string, hour int, factor double")
    p = frame(spark, [(1, 50, 0.2, 0.0, 0.0, 0.0, 10.0)], "contest_id long, tier int, base double, a double, b double, b_end double, panic double")
    r = M.forecast_skeleton(p, seen, c, frame(spark, [(1, 10.0)], "contest_id long, scale double"), flat).first()
    assert r["now_h"] == 14.0 and r["score_now"] == 150.0 and r["final"] > 150.0


def test_local_times_are_read_at_utc_8(spark):
    given = ["2024-03-01 08:00", "2024-03-01 08:00:30", " 2024-03-01 08:00 ", "2024-02-30 08:00", "01.03.2024", None, "2024-03-01"]
    got = [r[0] for r in frame(spark, [(x,) for x in given], "t string").select(C.parse_local_time(F.col("t"))).collect()]
    assert got == [1_709_251_200_000, 1_709_251_230_000, 1_709_251_200_000, None, None, None, None]
