"""Statuses and clean-up of the intake, and reading states as a stream."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from noticeloom.streaming import intake, readings

T = [datetime(2026, 1, 5, h) for h in range(24)]


def notice(source, key, title="t", at=T[0]):
    return {"source": source, "external_id": key, "title": title, "landed_at": at.isoformat(), "events": [], "prices": [], "rules": []}


def test_intake_tells_sources_that_land_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = lambda rows: spark.read.schema(intake.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
    first = [notice("lh", str(i)) for i in range(20)] + [notice("sh", "1"), notice("sh", "2", "")]
    intake.write_batch(store, batch(first), 0, sources=("lh", "sh", "gh"))
    second = [notice("sh", "1", "new", T[3]), notice("gh", "9", "", T[3])]
    for _ in range(2):  # a replay
        intake.write_batch(store, batch(second), 1, sources=("lh", "sh", "gh"))
    told = lambda i: {r.source: (r.status, r.record_count, r.last_success_at, r.last_attempt_at) for r in intake.statuses(spark, store, i).collect()}
    assert told(0) == {"lh": ("ok", 20, T[0], T[0]), "sh": ("partial", 1, T[0], T[0]), "gh": ("error", None, None, T[0])}
    assert told(1) == {"lh": ("error", 20, T[0], T[3]), "sh": ("ok", 1, T[3], T[3]), "gh": ("error", None, None, T[3])}
    assert {r.message for r in intake.statuses(spark, store, 1).filter("source = 'lh'").collect()} == {"nothing landed"}
    assert intake.current(spark, store, 1).count() == 21


def test_vacuum_keeps_what_the_last_manifests_name(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = lambda rows: spark.read.schema(intake.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
    for i in range(4):
        intake.write_batch(store, batch([notice("lh", "1", f"t{i}", T[i]), notice("lh", str(i + 2), "t", T[i])]), i)
    want = sorted(map(repr, intake.current(spark, store, 3).collect()))
    assert intake.vacuum(spark, store, 3, keep=2) > 0 and intake.vacuum(spark, store, 3, keep=2) == 0
    assert sorted(map(repr, intake.current(spark, store, 3).collect())) == want
    assert intake.current(spark, store, 2).count() == 4
    intake.write_batch(store, batch([notice("lh", "1", "again", T[5])]), 4)
    assert {r.title for r in intake.current(spark, store, 4).filter("external_id = '1'").collect()} == {"again"}


def test_current_of_an_empty_store_has_its_columns(spark, tmp_path):
    store = str(tmp_path / "store")
    intake.write_batch(store, spark.createDataFrame([], intake.PAYLOAD), 0)
    none = intake.current(spark, store, 0)
    intake.write_batch(store, spark.createDataFrame([], intake.PAYLOAD), 1)
    rows = spark.read.schema(intake.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(notice("lh", "1"))], 1))
    intake.write_batch(store, rows, 2)
    assert none.count() == 0 and set(none.columns) == set(intake.current(spark, store, 2).drop("bucket").columns)


def test_readings_wait_and_are_due_again(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def feed(n, *rows):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"source": "lh", "external_id": k, "status": s, "stale": stale, "at": at.isoformat()}) + "\n" for k, s, stale, at in rows))
        readings.start(spark, folder, out, checkpoint).awaitTermination()
        return sorted((r.external_id, r.event, r.at, r.deferred_until) for r in spark.read.parquet(out).collect())

    # two keys wait three hours and a day, one is done, one is stale and so due at once
    got = feed(1, ("a", "deferred", False, T[0]), ("b", "quota", False, T[0]), ("c", "done", False, T[0]), ("d", "done", True, T[0]))
    assert got == [("a", "read", T[0], T[3]), ("b", "read", T[0], datetime(2026, 1, 6)), ("c", "read", T[0], None), ("d", "due", T[0], None), ("d", "read", T[0], None)]
    got = feed(2, ("a", "deferred", False, T[2]), ("z", "done", False, T[2]))  # read again before the wait is over: the timer moves
    assert ("a", "read", T[2], T[5]) in got and not [x for x in got if x[0] == "a" and x[1] == "due"]
    got = feed(3, ("z", "done", False, T[4]))
    assert not [x for x in got if x[0] == "a" and x[1] == "due"]
    feed(4, ("z", "done", False, T[6]))
    got = feed(5, ("z", "done", False, T[7]))  # the watermark of the batch before has passed the timer
    assert [x for x in got if x[1] == "due"] == [("a", "due", T[5], None), ("d", "due", T[0], None)]
    again = feed(6, ("z", "done", False, T[8]))
    assert [x for x in again if x[1] == "due"] == [x for x in got if x[1] == "due"]


def test_table_and_stream_agree(spark, tmp_path):
    from noticeloom.operators.documents import reading_states

    rows = [("lh", str(i % 7), ("done", "deferred", "quota")[i % 3], i % 5 == 0, T[i % 6]) for i in range(30)]
    frame = spark.createDataFrame(rows, readings.READINGS)
    want = {r.external_id: (r.audited_on, r.deferred_until) for r in reading_states(None, frame).collect()}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps({"source": s, "external_id": k, "status": x, "stale": st, "at": at.isoformat()}) + "\n" for s, k, x, st, at in rows))
    readings.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.external_id: (r.audited_on, r.deferred_until) for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("event") == "read").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
