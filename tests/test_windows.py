"""Windows, pages, consensus, calendars, supersession, as-of values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from noticeloom.operators.consensus import agreed, all_of, any_of, conflicting, status_of
from noticeloom.operators.entities import current, exact_references
from noticeloom.operators.history import asof_latest
from noticeloom.operators.lookups import band, sized, tier
from noticeloom.operators.points import account_points, dependant_points, homeless_points, totals
from noticeloom.operators.windows import density, in_window, page

NOTICES = [(1, date(2026, 1, 5)), (2, date(2026, 1, 6)), (3, date(2026, 5, 1)), (4, date(2026, 1, 9)), (5, None)]
EVENTS = [
    (1, "general", "접수", date(2026, 3, 1), date(2026, 3, 3)), (1, "contract", "계약", date(2026, 1, 10), None), (2, "Contract", "계약", date(2026, 1, 10), None),
    (3, "first_priority", "상시 접수", date(2025, 12, 1), None), (4, "general", "접수", date(2025, 12, 1), None), (4, "general", "접수", None, None),
]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(NOTICES, "id int, announcement_date date"), spark.createDataFrame(EVENTS, "notice_id int, kind string, label string, start_date date, end_date date")


def test_window(tables):
    got = {r.id: r.sort_date for r in in_window(*tables, date(2026, 1, 1), date(2026, 1, 31)).collect()}
    assert got == {2: date(2026, 1, 10), 3: None}  # a list takes `Contract` for an application, as kinds count as written; open-ended
    lower = tables[1].withColumn("kind", F.lower("kind"))
    got = {r.id: r.sort_date for r in in_window(tables[0], lower, date(2026, 1, 1), date(2026, 1, 31)).collect()}
    assert got == {2: date(2026, 1, 6), 3: None}  # by announcement, for want of an application
    got = {r.id: r.sort_date for r in in_window(*tables, date(2026, 3, 2), date(2026, 3, 9), application_only=True).collect()}
    assert got == {1: date(2026, 3, 2), 3: None}
    assert in_window(*tables, None, None).count() == 5
    with pytest.raises(ValueError):
        in_window(*tables, date(2026, 2, 1), date(2026, 1, 1))


def test_page(tables):
    rows = page(tables[0], 2, 2, F.col("announcement_date").asc_nulls_last(), F.col("id")).collect()
    assert [(r.id, r.total) for r in rows] == [(4, 5), (3, 5)]
    with pytest.raises(ValueError):
        page(tables[0], 0, 2, F.col("id"))


def test_density_leaves_out_reversed_events(spark):
    rows = spark.createDataFrame([(date(2026, 1, 30), date(2026, 2, 2), True), (date(2026, 2, 1), date(2026, 1, 1), False), (date(2026, 2, 2), None, False)], "start_date date, end_date date, no boolean")
    got = {r.day.day: (r.n, r.all_unavailable) for r in density(rows, date(2026, 2, 1), date(2026, 2, 28), F.col("no")).collect()}
    assert got == {1: (1, True), 2: (2, False)}


def test_kleene_folds(spark):
    rows = [("t", True), ("t", None), ("f", False), ("f", None), ("n", None), ("tt", True), ("ff", False)]
    got = {r.k: (r.a, r.o) for r in spark.createDataFrame(rows, "k string, v boolean").groupBy("k").agg(all_of(F.col("v")).alias("a"), any_of(F.col("v")).alias("o")).collect()}
    assert got == {"t": (None, True), "f": (False, None), "n": (None, None), "tt": (True, True), "ff": (False, False)}
    empty = spark.createDataFrame([], "v boolean, s string").agg(all_of(F.col("v")).alias("a"), any_of(F.col("v")).alias("o"), status_of(F.col("s")).alias("s")).first()
    assert tuple(empty) == (None, None, "unpublished")


def test_consensus(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("b", 2, True), ("c", None, True)], "k string, v int, o boolean")
    got = {r.k: (r.v, r.c) for r in rows.groupBy("k").agg(agreed(F.col("v"), F.col("o")).alias("v"), conflicting(F.col("v"), F.col("o")).alias("c")).collect()}
    assert got == {"a": (1, False), "b": (None, True), "c": (None, False)}


def test_references_and_supersession(spark):
    rows = spark.createDataFrame(
        [(1, "s", "100:1", None, None), (2, "s", "101", None, "100"), (3, "s", "102:1", None, None), (4, "s", "102:2", None, None), (5, "s", "103", None, "102"), (6, "t", "9", 1, None), (7, "s", "104", None, "103")],
        "id int, source string, external_id string, duplicate_of_id int, correction_of_external_id string",
    )
    found = exact_references(rows)
    assert {r.id: r.correction_of_id for r in found.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: 5}  # two begin with 102:
    assert sorted(r.id for r in current(found).collect()) == [2, 3, 4, 7]  # 1 takes its duplicate 6 along


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 5, "z")], "k string, t int, v string")
    assert sorted((r.k, r.t, r.asof_v) for r in asof_latest(left, right, ["k"], "t", "t", ["v"]).collect()) == sorted([("a", 5, "y"), ("a", 1, None), ("b", 3, None)], key=str)


def test_lookups_and_points(spark):
    x = F.lit(102.0)
    row = spark.range(1).select(
        tier(x, [(85, 1), (102, 2), (None, 3)]).alias("a"), band(x, [(0, 85, "s"), (85, None, "l")]).alias("b"), sized(F.lit(7), {3: 10, 4: 20}, 5).alias("c"), sized(F.lit(1), {3: 10}).alias("d"),
        account_points(F.lit(5)).alias("e"), account_points(F.lit(30)).alias("f"), dependant_points(F.lit(9)).alias("g"), homeless_points(F.lit("2020-01-01").cast("date"), F.lit("2022-01-01").cast("date"), F.lit(False)).alias("h"),
        *[c.alias(n) for c, n in zip(totals(F.lit(None).cast("int"), F.lit(5), F.lit(7)), ("total", "confirmed"), strict=True)],
    ).first()
    assert tuple(row) == (2, "l", 35, 10, 1, 4, 35, 6, None, 12)
