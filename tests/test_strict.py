"""Documents that cannot be trusted come back as rejects with a reason, and nothing of them is read."""

import os

import pytest

from podium.sources import readers as R

BROKEN = {
    "cut": '{"event_id": 1, "tier_records": {"10": [{"time": 1, "ep": 2', "nan": '{"event_id": 1, "tier_records": {"10": [{"time": 1, "ep": NaN}]}}', "inf": '{"event_id": 1, "tier_records": {"10": [{"time": 1, "ep": -Infinity}]}}',
    "twice": '{"event_id": 1, "event_id": 2, "tier_records": {}}', "deep": '{"event_id": 1, "tier_records": {"10": [{"time": 1, "time": 2, "ep": 2}]}}', "blank": " \n", "text": "not json", "behind": '{"event_id": 1, "tier_records": {}} {', "list": '{"event_id": 1}, {"event_id": 2}', "closed": '{"event_id": 1}] [{"event_id": 2}',
}
TYPED = {"word": '{"event_id": 1, "tier_records": {"10": [{"time": 1, "ep": "many"}]}}', "half": '{"event_id": 1, "tier_records": {"10": [{"time": 1.5, "ep": 2}]}}', "shape": '{"event_id": 1, "tier_records": [1]}', "namedNaN": '{"event_id": 1, "tier_records": {"10": [{"time": 1, "ep": "NaN"}]}}'}


def files(tmp_path, docs):
    for name, text in docs.items():
        (tmp_path / f"{name}.json").write_text(text)
    return str(tmp_path / "*.json")


def reasons(df):
    return {os.path.basename(r["file"]).removesuffix(".json"): r["reason"] for r in df.collect()}


def test_cache_documents(spark, tmp_path):
    good = {"good": '{"event_id": 7, "meta": {"start_at": 0, "end_at": 9, "event_type": "a"}, "tier_records": {"10": [{"time": 1, "ep": 2.5, "more": [1]}]}, "other": null}', "noid": '{"tier_records": {}}'}
    contests, rows, rewards, bad = R.read_contest_cache(spark, files(tmp_path, BROKEN | TYPED | good))
    assert reasons(bad) == dict.fromkeys(BROKEN, "not_json") | dict.fromkeys(TYPED, "wrong_type") | {"noid": "no_id"}
    assert [(r["contest_id"], r["tier"], r["time_ms"], r["score"]) for r in rows.collect()] == [(7, 10, 1, 2.5)]
    assert [r["contest_id"] for r in contests.collect()] == [7] and rewards.count() == 1


@pytest.mark.parametrize("kind", ["payload", "points", "rewards"])
def test_other_documents(spark, tmp_path, kind):
    key = {"payload": "cutoffs", "points": "points", "rewards": "rankingRewards"}[kind]
    row = {"payload": '{"time": 1, "ep": %s}', "points": '{"uid": 1, "time": 1, "value": %s}', "rewards": '[{"toRank": %s, "rewardType": "a", "rewardId": 1}]'}[kind]
    doc = '{"result": true, "eventId": 3, "%s": [%s]}'
    docs = {"good": doc % (key, row % 5), "cut": (doc % (key, row % 5))[:-3], "nan": doc % (key, row % "NaN"), "word": doc % (key, row % '"x"'), "none": doc % (key, "")}
    path = files(tmp_path, docs)
    rows, bad = {"payload": lambda: R.read_tracker_payload(spark, path), "points": lambda: R.read_player_points(spark, path), "rewards": lambda: R.read_rewards(spark, path, 0)}[kind]()
    assert rows.count() == 1
    assert reasons(bad) == {"cut": "not_json", "nan": "not_json", "word": "wrong_type", "none": "no_rewards" if kind == "rewards" else "empty"}
