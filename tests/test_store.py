"""The versioned store and its intake stream."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeloom.operators.store import PAYLOAD, after_results, audit, checked, competition_result, duplicates, upsert
from noticeloom.streaming.intake import current, revisions, start, write_batch


def row(key, **more):
    base = {"source": "s", "external_id": key, "title": f" T {key} ", "address": "A", "announcement_date": "2026-01-02", "price_cap_status": "unknown", "events": [{"kind": "general", "label": "x", "start_date": "2026-02-01", "end_date": "2026-01-01"}, {"kind": "general"}], "prices": []}
    return json.dumps({**base, **more}, ensure_ascii=False)


def batch(spark, *rows):
    return spark.read.schema(PAYLOAD).json(spark.sparkContext.parallelize(rows))


def at(hour):
    return F.lit(datetime(2026, 1, 3, hour))


def test_rejects(spark):
    good, bad = checked(batch(spark, row("1"), row("2", title=" "), row("3", price_cap_status="maybe"), row("4", prices=[{"unit_type": "A", "price_kind": "sale", "amount_krw": -1}]), row(None), row("6", prices=[{"unit_type": "A", "price_kind": "gift"}, {"unit_type": " "}])))
    assert [r.external_id for r in good.collect()] == ["1"]
    assert sorted(r.error for r in bad.collect()) == ["a price kind is unknown", "external_id is missing", "money is negative", "price_cap_status is unknown", "title is missing"]
    event = good.first().events
    assert len(event) == 1 and event[0].end_date is None  # no start: left out; an end before the start: none


def test_versions(spark):
    one, _ = checked(batch(spark, row("1"), row("2")))
    state, first = upsert(None, one, at(1))
    assert sorted((r.external_id, r.version) for r in first.collect()) == [("1", 1), ("2", 1)]
    again, none = upsert(state, one, at(2))
    assert none.count() == 0 and {r.last_seen_at.hour for r in again.collect()} == {2}
    two, _ = checked(batch(spark, row("1", announcement_date="2026-01-05", category="new")))
    after, more = upsert(again, two, at(3))
    rows = {r.external_id: r for r in after.collect()}
    assert [(r.external_id, r.version) for r in more.collect()] == [("1", 2)]
    assert rows["1"].proof_invalidated and not rows["2"].proof_invalidated
    assert str(rows["1"].original_date) == "2026-01-02" and rows["2"].last_seen_at.hour == 2
    three, _ = checked(batch(spark, row("1", announcement_date="2026-01-05", category=None)))
    _, same = upsert(after, three, at(4))
    assert same.count() == 0  # a null keeps what was known


def test_duplicates_do_not_depend_on_order(spark):
    rows, _ = checked(batch(spark, row("1"), row("9", source="t", title="T 1"), row("2", title="other")))
    state, _ = upsert(None, rows, at(1))
    got = {(r.source, r.external_id): (r.canonical.source, r.canonical.external_id) for r in duplicates(state).collect()}
    assert got == {("s", "1"): ("s", "1"), ("t", "9"): ("s", "1"), ("s", "2"): ("s", "2")}


def test_stale_and_failed_results(spark):
    states = spark.createDataFrame([(1, 2), (2, 1)], "notice_id int, version int")
    results = spark.createDataFrame([(1, 1, ["x"], True), (1, 2, ["x"], True), (2, 1, None, True), (3, 1, ["x"], True)], "notice_id int, expected_version int, rows array<string>, complete boolean")
    got = sorted((r.notice_id, r.expected_version, r.outcome, r.complete) for r in competition_result(states, results).collect())
    assert got == [(1, 1, "stale", False), (1, 2, "accepted", True), (2, 1, "failed", False), (3, 1, "stale", False)]


def test_accepted_results_clear_the_invalidation(spark):
    rows = spark.createDataFrame([(1, True), (2, True), (3, False)], "id int, proof_invalidated boolean")
    outcomes = spark.createDataFrame([(1, "accepted"), (1, "stale"), (2, "failed")], "notice_id int, outcome string")
    assert {r.id: r.proof_invalidated for r in after_results(rows, outcomes).collect()} == {1: False, 2: True, 3: False}


def test_the_last_landed_row_of_a_batch_counts(spark):
    rows, _ = checked(batch(spark, row("1", category="z", landed_at="2026-01-03T01:00:00Z"), row("1", category="a", landed_at="2026-01-03T02:00:00Z")))
    state, more = upsert(None, rows, at(3))
    assert state.first().category == "a" and more.count() == 1 and "landed_at" not in state.columns


def test_stream_and_replay(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    first, then = {"landed_at": "2026-01-03T01:00:00Z"}, {"landed_at": "2026-01-03T04:00:00Z"}
    (landing / "a.json").write_text("\n".join([row("1", **first), row("2", **first), *(row(f"k{i}", **first) for i in range(60))]))
    args = (spark, str(landing), str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    start(*args).awaitTermination()
    (landing / "b.json").write_text("\n".join([row("1", **then), row("2", category="new", **then)]))
    start(*args).awaitTermination()
    state = {r.external_id: (r.version, r.last_seen_at.hour) for r in current(spark, args[2], 1).collect()}
    assert len(state) == 62 and state["1"] == (1, 4) and state["2"] == (2, 4) and state["k7"] == (1, 1)
    assert revisions(spark, args[2]).count() == 63
    written = spark.read.parquet(f"{args[2]}/current/1").count()
    assert written < 20  # the buckets of two keys alone
    before = sorted(map(str, current(spark, args[2], 1).collect()))
    write_batch(args[2], batch(spark, row("1", **then), row("2", category="new", **then)), 1)  # the batch again, as after a failure
    assert revisions(spark, args[2]).count() == 63 and sorted(map(str, current(spark, args[2], 1).collect())) == before
    with pytest.raises(FileNotFoundError):
        write_batch(args[2], batch(spark, row("1", **then)), 7)  # the state before is missing
    with pytest.raises(ValueError, match="seen_at"):
        write_batch(args[2], batch(spark, row("1")), 2)


def test_audit(spark, tmp_path):
    rows = spark.createDataFrame([("lh", "ok", 1), ("lh", "ok", 2), ("ih", "failed", 3)], "source string, outcome string, id int")
    audit(rows, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/rows").count() == 3
    assert sorted((r.source, r.outcome, r["count"]) for r in spark.read.json(f"{tmp_path}/summary").collect()) == [("ih", "failed", 1), ("lh", "ok", 2)]
