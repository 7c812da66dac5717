"""Wordings, tables without lines, readings, boards, statuses and rosters at their edges."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticeloom.operators import documents, flat_tables
from noticeloom.operators.rosters import rosters
from noticeloom.operators.statuses import counted, updated, with_missing
from noticeloom.operators.wordings import conditions, section_texts
from noticeloom.sources.boards import collected, scanned
from noticeloom.sources.html import document_links

LINES = "doc int, section string, page int, line int, text string"


def test_wordings_over_lines(spark):
    rows = [
        (1, "일반", 1, 0, "무주택"), (1, "일반", 1, 1, "  "), (1, "일반", 2, 0, "세대   구성원"), (1, "일반", 2, 1, None),
        (2, None, 1, 0, "만 19세"), (2, None, 1, 1, "이상의 직계존속"), (3, "x", 1, 0, "■ 무주택 ■ 세대구성원"), (4, "x", 1, 0, None),
        (5, "다른", 1, 0, "세대구성원 과거 주택 소유"), (6, "x", 1, 0, "① 무주택세대구성원 ② 예비신혼부부 ③ 무주택세대주 (출산특례) 혼인 특례"),
    ]
    frame = spark.createDataFrame(rows, LINES).repartition(3)
    got = {(r.doc, r.kind, r.page, r.line, r.start, r.end, tuple(e.kind for e in r.exemptions)) for r in conditions(frame, ["doc"]).collect()}
    assert got == {(1, "homeless", 1, 0, 0, 10, ()), (6, "homeless", 1, 0, 2, 10, ()), (6, "homeless", 1, 0, 22, 28, ("birth_relief",))}
    text = section_texts(frame, ["doc"]).filter("doc = 1").first()
    assert text.text == "무주택 세대 구성원" and [(p.start, p.page, p.line) for p in text.places] == [(0, 1, 0), (4, 2, 0)]
    assert conditions(frame.limit(0), ["doc"]).count() == 0


def test_tables_without_lines(spark):
    labels = {"a": "처음", "b": "나중"}
    texts = ["처음 나중 2026.01.02 2026.01.03 2026.01.04", "나중 처음 2026.01.02 2026.1.3", "처음 2026.01.02", "처음 나중 2026.01.02", "없음 2026.01.02", None]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(flat_tables.paired(F.col("t"), labels, flat_tables.DAY).alias("m")).collect()]
    assert got == [{"a": "2026.01.02", "b": "2026.01.03"}, {"b": "2026.01.02", "a": "2026.1.3"}, {"a": "2026.01.02"}, None, None, None]
    spans = ["2026.01.05(월) ~ 01.07(수)", "2026년 1월 5일", "2026.01.05 ~ 2026.01.04", "2026.02.30", "2026.12.30 ~ 2027.1.2"]
    got = [r.p and (r.p.start, r.p.end) for r in spark.createDataFrame([(t,) for t in spans], "t string").coalesce(1).select(flat_tables.period(F.col("t")).alias("p")).collect()]
    assert got == [(date(2026, 1, 5), date(2026, 1, 7)), (date(2026, 1, 5), date(2026, 1, 5)), None, None, (date(2026, 12, 30), date(2027, 1, 2))]


def test_cutoffs_of_schedule_tables(spark):
    table = "구분 최초 무순위(사후) 입주자모집공고일 일정 2026.01.02 2026.02.03"
    pages = [(1, 2, table), (2, 4, table), (3, 1, table), (3, 2, table.replace("02.03", "02.04")), (4, 1, table), (4, 3, "본 주택의 무순위(사후) 입주자모집공고일은 2026.03.04"), (5, 1, "이 주택의 최초 입주자모집공고일은 2026.01.02"), (6, 1, table.replace("2026.02.03", "2026.02.31"))]
    got = {r.notice_id: r.day for r in documents.cutoffs(spark.createDataFrame(pages, "notice_id int, page int, text string").withColumn("method", F.lit("unranked_after")), "method").collect()}
    assert got == {1: date(2026, 2, 3), 4: date(2026, 3, 4)}  # page 4 isn't looked at, two tables differ, sentences first, no other project's day


def test_boards_stop_and_degrade(spark):
    day = date(2026, 1, 10)
    row = lambda t, d=day: [(t, d)]
    pages = [
        ("a", 1, False, row("1")), ("a", 2, False, row("2")), ("a", 3, False, row("1")), ("a", 4, True, None), ("b", 1, False, []), ("c", 1, False, row("1")), ("c", 2, True, None),
        ("d", 1, False, row("1", date(2025, 1, 1))), ("d", 2, True, None), ("e", 1, False, row("1")), ("e", 2, False, row("2")), ("e", 3, False, row("3")), ("f", 1, False, row("1")), ("f", 2, False, None),
    ]
    frame = spark.createDataFrame(pages, "board string, page int, failed boolean, rows array<struct<title:string,day:date>>")
    rows, outcomes = scanned(frame, date(2026, 1, 1), most=3)
    assert {(r.board, r.page) for r in rows.collect()} == {("a", 1), ("a", 2), ("c", 1), ("d", 1), ("e", 1), ("e", 2), ("e", 3), ("f", 1)}
    assert {r.board: r.outcome for r in outcomes.collect()} == {"a": "ok", "b": "empty", "c": "failed", "d": "ok", "e": "limit", "f": "ok"}
    boards = spark.createDataFrame([("a", "x", False), ("c", "x", True), ("f", "y", False), ("b", "y", False), ("gone", "z", True)], "board string, source string, optional boolean")
    own, polls = collected(rows, outcomes, boards, F.col("day") >= date(2026, 1, 1), F.lit(datetime(2026, 1, 11)))
    assert {(r.source, r.board, r.title) for r in own.collect()} == {("x", "a", "1"), ("x", "a", "2")}
    assert {r.source: (r.status, r.message, r.record_count) for r in polls.collect()} == {"x": ("partial", "c:failed", 2), "y": ("error", "b:empty", None), "z": ("partial", "gone:missing", 0)}


def test_statuses_keep_the_last_success(spark):
    at = [datetime(2026, 1, 5, h) for h in range(5)]
    kind = "source string, status string, message string, record_count long, at timestamp"
    poll = lambda *rows: spark.createDataFrame(rows, kind)
    one = updated(None, poll(("a", "ok", None, 5, at[0]), ("a", "error", "x", None, at[1]), ("b", "partial", "m", 0, at[0]), ("", "ok", None, 1, at[0]), ("c", "odd", None, 1, at[0])))
    two = updated(one, poll(("b", "error", "gone", None, at[2]), ("d", "running", None, None, at[2])))
    got = {r.source: (r.status, r.message, r.last_attempt_at, r.last_success_at, r.record_count) for r in two.collect()}
    assert got == {"a": ("error", "x", at[1], at[0], 5), "b": ("error", "gone", at[2], at[0], 0), "d": ("running", None, at[2], None, None)}
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("",)], "source string")
    told = {r.source: (r.status, r.record_count) for r in with_missing(counted(rows, rows.filter("source = 'b'").unionByName(rows.filter("source = 'x'")), F.lit(at[0])), ["a", "q"], F.lit(at[0])).collect()}
    assert told == {"a": ("ok", 2), "b": ("partial", 1), "q": ("error", None)}


def test_rosters_of_odd_bodies(spark):
    bodies = [None, "[]", "{", '{"version":5}', '{"version":5,"householdMembers":"x","ownershipFacts":{}}', '{"version":9,"householdMembers":[{}]}', '{"version":4,"householdMembers":[[],{},1]}', '{"version":3,"ownershipFacts":[{"ownerRelation":"other","ownerMemberId":"m"}],"householdMembers":[{}]}']
    got = {r.profile_id: (len(r.members), len(r.homes)) for r in rosters(spark.createDataFrame(list(enumerate(bodies)), "profile_id int, body string")).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (1, 0), 7: (0, 1)}
    home = rosters(spark.createDataFrame([(1, bodies[-1])], "profile_id int, body string")).first().homes[0]
    assert (home.id, home.ownerMemberId, home.ownerRelation, home.officialValueKrw, home.ownedShare) == ("property-1", "", "other", None, None)


def test_document_links_need_trusted_pages(spark):
    page = '<a href="/a.PDF">x</a><a>none</a><a href="/b?attach=1">첨부파일</a><a href="http://evil.example/a.pdf">공고문</a><a href="/c.pdf">팜플렛</a>'
    frame = spark.createDataFrame([(page, "https://x.example/"), (page, "https://evil.example/"), (None, "https://x.example/"), (page, None)], "h string, b string").coalesce(1)
    got = [r.l for r in frame.select(document_links(F.col("h"), F.col("b"), ("x.example",)).alias("l")).collect()]
    assert got == [["https://x.example/a.PDF", "https://x.example/b?attach=1"], [], [], []]


def test_rows_of_notices_are_not_sent_through_the_driver(spark):
    """Tables with a row for each notice are joined by shuffles however small they seem."""
    import os

    import pytest

    from noticeloom.plans.reading_queries import method_cutoff_criterion

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver tables")
    plan = method_cutoff_criterion(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 4


def test_clauses_without_a_wordings_words_are_not_searched(spark):
    import dataclasses
    import random

    from noticeloom.operators.wordings import EXEMPTIONS, WORDINGS, clauses, conditions
    from noticeloom.plans.reading_queries import SAID

    for w in (*WORDINGS, *EXEMPTIONS):
        assert w.needs and all(x in w.pattern for words in w.needs for x in words.split("|"))
    chance, parts = random.Random(3), [t for _, lines, _ in SAID for _, t in lines]
    more = ["출산 특례", "5년 이상 장기복무", "납부 의무", "임신", "국내 만 30세 이상인 자", "청약저축 불요", "거주지 무관", "직계존속을 2년 이상 부양", "2세 미만 자녀", "외국인의 경우 불가능", "과거 5년 이내 당첨 없는"]
    rows = [(i, chance.choice(["신생아", "생애최초", None]), 1, j, chance.choice(parts + more)) for i in range(300) for j in range(chance.randint(1, 6))]
    rows += [(1000 + k, section, page, j, text) for k, (section, lines, _) in enumerate(SAID) for j, (page, text) in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc int, section string, page int, line int, text string")
    all_words = [tuple(dataclasses.replace(x, needs=()) for x in xs) for xs in (WORDINGS, EXEMPTIONS)]
    got = [sorted(map(repr, x.collect())) for x in (conditions(frame, ["doc"]), conditions(frame, ["doc"], *all_words))]
    assert got[0] == got[1] and len({r.split("kind=")[1].split(",")[0] for r in got[0]}) == len(WORDINGS)
    texts = spark.createDataFrame([(0, "a ■ b① c"), (1, "plain"), (2, ""), (3, None), (4, "■")], "i int, t string")
    assert [r.c and [tuple(x) for x in r.c] for r in texts.select("i", clauses(F.col("t")).alias("c")).orderBy("i").collect()] == [[(0, "a "), (2, "■ b"), (5, "① c")], [(0, "plain")], [(0, "")], None, [(0, "■")]]
