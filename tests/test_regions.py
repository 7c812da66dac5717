"""Regions, leaves, validity, availability and documents on rows with nulls and at their edges."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticeloom.functions.labels import application_fee, source_name
from noticeloom.operators import availability, documents, listing, regions, validity
from noticeloom.operators.leaves import TESTS, with_facts
from noticeloom.operators.rules import evaluate, nodes

CATALOGUE = [("11680", "강남구", "11", None, date(1990, 1, 1)), ("41110", "수원시", "41", None, date(1990, 1, 1)), ("41111", "장안구", "41", "41110", date(2020, 1, 1)), ("26110", "중구", "26", None, date(1990, 1, 1)), ("26111", "중 구", "26", None, date(1990, 1, 1))]


def districts(spark):
    return spark.createDataFrame(CATALOGUE, "code string, name string, province_code string, parent_code string, valid_from date")


def test_codes_and_names(spark):
    codes = [("11", "11", None), ("11000", "11", None), ("1100000000", "11", None), ("11680", "11", "11680"), ("1168000000", "11", "11680"), ("1168010100", None, None), ("99999", None, None), (None, None, None), ("", None, None)]
    rows = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(codes)], "i int, code string")
    got = {r.i: r.place for r in regions.by_code(rows, "code", districts(spark), "place").collect()}
    assert [(got[i] and got[i].province, got[i] and got[i].district) for i in range(len(codes))] == [(p, d) for _, p, d in codes]
    names = [("서울", "11", None), ("서울특별시 강남구", "11", "11680"), ("강남구", "11", "11680"), ("경기도 전체", "41", None), ("수원시", None, None), ("부산 중구", None, None), ("서울·경기", None, None), ("광주", None, None), ("전남광주통합특별시", "12", None), (None, None, None)]
    rows = spark.createDataFrame([(i, n) for i, (n, *_) in enumerate(names)], "i int, name string")
    got = {r.i: r.place for r in regions.by_name(rows, "name", F.lit("11"), districts(spark), "place").collect()}
    assert [(got[i] and got[i].province, got[i] and got[i].district) for i in range(len(names))] == [(p, d) for _, p, d in names]  # two of one name are none
    rows = spark.createDataFrame([("서울", "강남구"), ("부산", "중구"), ("어디", None), (None, None), ("서울", " ")], "r string, d string")
    got = [(r.region_code, r.district_code, r.needs_review) for r in regions.resolve(rows, "r", "d", districts(spark)).collect()]
    assert sorted(got, key=str) == sorted([("11", "11680", False), ("26", None, True), (None, None, True), (None, None, False), ("11", None, False)], key=str)
    assert [r.code for r in regions.district_options(districts(spark), "41").collect()] == ["41110"]


def test_scopes_of_unknown_homes(spark):
    place = lambda p, d=None, parent=None: F.struct(F.lit(p).cast("string").alias("province"), F.lit(d).cast("string").alias("district"), F.lit(parent).cast("string").alias("parent"), F.lit(date(1990, 1, 1)).alias("valid_from"))
    none = F.lit(None).cast(regions.PLACE)
    t, f, day = F.lit(True), F.lit(False), F.lit(date(2026, 8, 1))
    cases = [(place(None), place("11"), none, t, f, None), (place("11"), none, none, f, f, None), (place("11", "11680"), place("11"), none, t, f, True), (place("41", "41111", "41110"), none, place("41", "41110"), f, t, True),
             (place("41", "41110"), none, place("41", "41111", "41110"), f, t, None), (place("26", "26110"), none, place("11"), f, t, False), (place("11", "11680"), place("11", "11680"), place("26"), t, t, None), (place("11", "11680"), place("11"), none, t, t, None)]
    got = spark.range(1).select(*[regions.matches_scope(*c[:5], day).alias(str(i)) for i, c in enumerate(cases)]).first()
    assert list(got) == [c[5] for c in cases]


def test_leaves_without_facts_are_open(spark):
    rules = [(k, f'{{"kind":"{k}","value":1,"verification":"official"}}') for k in TESTS]
    people = with_facts(spark.createDataFrame([(1, None)], "profile_id int, birth date"))
    got = {r.rule_id: r.result for r in evaluate(nodes(spark.createDataFrame(rules, "rule_id string, rule string")), people, ["profile_id"], TESTS).collect()}
    assert set(got) == set(TESTS) and set(got.values()) == {"review"}


def test_validity_of_nothing(spark):
    none = nodes(spark.createDataFrame([("r", "not json")], "rule_id string, rule string"))
    assert [(r.requirement, r.verified) for r in validity.verified_rules(none).collect()] == [(True, False)]
    empty = validity.complete_notices(spark.createDataFrame([], "notice_id int, requirement boolean, verified boolean"), spark.createDataFrame([], "notice_id int, complete boolean, topics array<struct<required:boolean,status:string>>"), spark.createDataFrame([(1, True), (2, None)], "notice_id int, declared boolean"))
    assert {r.notice_id: r.complete for r in empty.collect()} == {1: False, 2: False}  # nothing required certifies nothing


def test_availability_never_rests_on_what_is_missing(spark):
    event = lambda kind, label: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("audience"))
    combos = F.from_json(F.lit("[]"), "array<struct<supply_type:string,status:string>>")
    got = spark.range(1).select(
        availability.event_unavailable(event("general", "접수"), F.lit("other"), F.lit(None).cast("boolean"), combos, F.lit(False), F.lit(None).cast("string")).alias("a"),
        availability.event_unavailable(event("special", "특별공급"), F.lit("other"), F.lit(False), combos, F.lit(True), F.lit("mismatch")).alias("b"),
        availability.row_unavailable(F.lit("84A"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit("mismatch")).alias("c"),
    ).first()
    assert tuple(got) == (False, False, False)


def test_receptions_and_fees(spark):
    events = [("Contract", "계약", date(2026, 1, 1), None), ("general", "상시 접수", date(2026, 1, 1), None), ("general", "접수", date(2026, 1, 5), date(2026, 1, 9)), ("general", "계약 체결", date(2026, 1, 5), None)]
    rows = spark.createDataFrame([(events,)], "events array<struct<kind:string,label:string,start_date:date,end_date:date>>")
    assert [e.label for e in rows.select(listing.active_receptions(F.col("events"), F.lit(date(2026, 1, 7))).alias("x")).first().x] == ["상시 접수", "접수"]
    assert rows.select(listing.is_active(F.lit(None).cast(rows.schema["events"].dataType), F.lit(None).cast("date"), F.lit(date(2026, 1, 7))).alias("x")).first().x is False
    got = spark.range(1).select(source_name(F.lit("lh"), F.lit(None).cast("string")).alias("a"), source_name(F.lit("x"), F.lit("https://www.lh.or.kr/a")).alias("b"), application_fee(F.lit(None).cast("array<struct<kind:string,verification:string,units:array<struct<unit_type:string,application_fee_krw:bigint>>>>"), F.lit("A")).alias("c")).first()
    assert tuple(got) == ("LH", "LH", None)


def test_waits_of_documents(spark):
    at = datetime(2026, 1, 5, 10)
    readings = spark.createDataFrame([("lh", "1", "quota", False, at), ("lh", "2", "deferred", False, at), ("lh", "3", "ok", False, at), ("lh", "4", "ok", True, at)], "source string, external_id string, status string, stale boolean, at timestamp")
    state = documents.reading_states(None, readings)
    assert {r.external_id: (r.audited_on, r.deferred_until) for r in state.collect()} == {"1": (at.date(), datetime(2026, 1, 6, 10)), "2": (at.date(), datetime(2026, 1, 5, 13)), "3": (at.date(), None), "4": (None, None)}
    notices = spark.createDataFrame([("lh", str(i), False) for i in range(1, 6)] + [("lh", "9", True)], "source string, external_id string, changed boolean")
    due = lambda hour: sorted(r.external_id for r in documents.due_readings(notices, state, F.lit(datetime(2026, 1, 5, hour))).collect())
    assert due(11) == ["4", "5", "9"] and due(14) == ["2", "4", "5", "9"]
