"""What a task groups is bounded by rows, not by its share of a file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import availability, evaluation, people, tables, validity
from noticeloom.operators.dealing import dealt
from noticeloom.operators.rules import nodes


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_tasks_grow_with_rows(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert dealt(rows, "id", each=100).rdd.getNumPartitions() == 10 and dealt(rows, "id").rdd.getNumPartitions() == 4
    assert dealt(rows.limit(0), "id").count() == 0
    assert {tuple(r) for r in dealt(rows, "id", each=100).collect()} == {(i,) for i in range(1000)}


def test_supplies_deal_rows_before_they_group(spark):
    rows = [(i, k, "84.9500A", ["1", "-", "", "0", "0", "0", "2", str(3 + k // 2)]) for i in range(4) for k in range(2 + (i == 3))]
    frame = spark.createDataFrame(rows, "doc int, row int, unit string, counts array<string>")
    out = tables.supplies(frame, ["doc"])
    assert sorted(map(tuple, out.collect())) == sorted((i, "084.9500A", s, n) for i in range(3) for s, n in (("기관추천", 1), ("일반", 2)))
    text = plan(out)
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text


def test_shared_reasons_of_dealt_rows_are_not_dealt_again(spark):
    frame = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "a", 2)], "notice_id int, supply_type string, rule_id int")
    own = dealt(frame, "notice_id").groupBy(F.lit(1).alias("profile_id"), "notice_id", "supply_type").agg(F.collect_set(F.struct("rule_id", F.lit("pass").alias("result"))).alias("reasons"))
    out = evaluation.shared_reasons(own)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1, "pass", 2)] and plan(out).count("Exchange hashpartitioning") == 1


def test_special_diagnoses_deal_rows_before_they_group(spark):
    offered = spark.createDataFrame([(1, "신혼부부 특별공급"), (1, "일반공급"), (1, None), (2, "생애최초")], "notice_id int, supply_type string")
    results = spark.createDataFrame([(7, 1, None, "age_min", "pass"), (7, 2, "생애최초", "age_min", "pass")], "profile_id int, notice_id int, supply_type string, kind string, result string")
    certified = spark.createDataFrame([(2, "생애최초"), (1, None), (2, "청년")], "notice_id int, supply_type string")
    out = availability.special_diagnoses(offered, results, certified)
    assert {(r.notice_id, r.supply_type, r.status) for r in out.collect()} == {(1, "신혼부부 특별공급", "review"), (1, None, "review"), (2, "생애최초", "possible")}
    assert plan(out).count("REPARTITION_BY_NUM") == 2


def test_households_deal_members_before_they_group(spark):
    members = spark.createDataFrame([("a", "1", "child", "applicant"), ("a", "2", "child", "applicant"), ("b", "1", "child", "applicant"), ("b", "1", "child", "applicant")], "profile_id string, member_id string, relation string, register string")
    profiles = spark.createDataFrame([(x, True, False, True, True) for x in "ab"], "profile_id string, on_register boolean, has_spouse boolean, same_register boolean, roster_complete boolean")
    out = people.households(members, profiles)
    assert {r.profile_id: r["size"] for r in out.collect()} == {"a": 3, "b": None} and "REPARTITION_BY_NUM" in plan(out)


def test_catalogue_judges_once(spark):
    judged = spark.createDataFrame([("p", 1, "possible"), ("q", 1, "mismatch"), ("p", 9, "mismatch"), ("p", None, "possible")], "profile_id string, notice_id int, status string")
    notices = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    out = evaluation.catalogue(judged, notices)
    want = [("p", 1, "possible"), ("p", 9, "mismatch"), ("p", None, "possible"), ("q", 1, "mismatch"), (None, 2, "unpublished"), (None, 2, "unpublished"), (None, None, "unpublished")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and "Join" not in plan(out)


def test_models_are_read_before_they_are_joined(spark):
    from noticeloom.sources.feeds import reb_prices

    details = spark.createDataFrame([("1", "2", "0201", None), ("2", "2", "0203", None)], "HOUSE_MANAGE_NO string, PBLANC_NO string, SEARCH_HOUSE_SECD string, RENT_SECD string")
    models = spark.createDataFrame([("1", "2", "84A", "G", "84.5", "1,000"), ("1", "2", "-", "G", "1", "1"), ("2", "2", "59", None, None, "5")], "HOUSE_MANAGE_NO string, PBLANC_NO string, HOUSE_TY string, GP string, SUPLY_AR string, SUPLY_AMOUNT string")
    out = reb_prices(details, models, "urban")
    assert {(r.house_no, r.unit_type, r.area_sqm, r.price_kind, r.amount_krw) for r in out.collect()} == {("1", "G 84A", 84.5, "sale_max", 10_000_000), ("2", "59", None, "deposit", None)}
    join = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    below = out._jdf.queryExecution().optimizedPlan().toString().split(join)[1]
    assert "_amount" in below


def test_ranked_notices_are_told_by_days_alone(spark):
    from noticeloom.sources import reb_metadata as metadata

    rows = spark.createDataFrame([("2026-01-02", None), ("x", "20260103"), ("x", None), (None, None)], "GNRL_RNK1_CRSPAREA_RCPTDE string, GNRL_RNK2_ETC_AREA_RCPTDE string")
    out = rows.coalesce(1).select(metadata.is_ranked(rows, metadata.APT).alias("ranked"))
    assert [r.ranked for r in out.collect()] == [True, True, False, False] and "array" not in out._jdf.queryExecution().optimizedPlan().toString()


def _tree(rng, depth):
    """A tree with whatever a rule may lack."""
    node = {k: v for k, v in {"kind": rng.choice(["all", "age_min", "offered_supplies", None]), "effect": rng.choice([None, None, "metadata"]), "verification": rng.choice(["official", "official", "official", None]), "source": rng.choice([None, validity.PARSER, "feed"]), "parser_version": rng.choice([None, "v9", "v9", "v8", "v7", "v1"]), "document_hash": rng.choice([None, "h", "h", "x"])}.items() if v}
    if depth:
        node |= {k: [_tree(rng, depth - 1) if rng.random() < 0.9 else rng.choice([None, "text", 3, '{"kind":"all"}']) for _ in range(rng.randint(0, 2))] for k in ("conditions", "exceptions") if rng.random() < 0.6}
    return node


def test_rules_are_judged_in_their_rows(spark):
    from noticeloom.operators.rules import with_nodes

    rng = random.Random(3)
    trees = [(str(i), i % 40, json.dumps(_tree(rng, 3))) for i in range(300)] + [("x", 1, "not json"), ("y", 1, None), ("z", 1, "[]")]
    frame = spark.createDataFrame(trees, "rule_id string, notice_id int, rule string")
    old = {r.rule_id: (r.requirement, r.verified) for r in validity.verified_rules(nodes(frame.select("rule_id", "rule"))).collect()}
    out = validity.with_verified(frame)
    assert {r.rule_id: (r.requirement, r.verified) for r in out.collect()} == old and len(set(old.values())) == 4
    given = nodes(frame.select("rule_id", "rule")).join(frame.select("rule_id", "notice_id"), "rule_id").collect()
    notices = [(i, ("apt", "unsold")[i % 2], ("모집", "무순위 모집")[i % 3 == 0], ("h", None)[i % 5 == 0]) for i in range(1, 40)]
    read = {r.notice_id for r in given if r.source == validity.PARSER and r.parser_version == "v9"}
    of = {x[0]: x for x in notices}

    def holds(r):
        _, category, title, document = of[r.notice_id]
        v = r.parser_version
        version_ok = v == "v9" or (v == "v8" or (v == "v7" and category != "unsold" and "무순위" not in title)) and r.notice_id not in read
        return r.source != validity.PARSER or (version_ok and (document is None or r.document_hash == document))

    want = {r.rule_id for r in given if r.notice_id in of} - {r.rule_id for r in given if r.notice_id in of and not holds(r)}
    known = spark.createDataFrame(notices, "notice_id int, category string, title string, document_hash string")
    valid = validity.valid_rules(dealt(frame, "notice_id"), known.hint("merge"), "v9", usable=("v8",), ordinary=("v7",))
    got = [r.rule_id for r in valid.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 290
    text = plan(valid)
    assert text.count("Exchange hashpartitioning") == 2 and "Exchange" not in plan(out)  # rules once, notices once
    deep = {"kind": "not", "conditions": []}
    for _ in range(8):
        deep = {"kind": "not", "exceptions" if _ == 3 else "conditions": [deep]}
    for levels, rule in ((9, deep), (0, {"conditions": [deep]})):
        made = with_nodes(spark.createDataFrame([(json.dumps(rule),)], "rule string"), ("kind",)).select(F.size("nodes").alias("n"))
        if levels:
            assert made.first().n == 9
        else:
            with pytest.raises(Exception, match="nested more than 8"):
                made.collect()


def test_deposit_lines_are_dealt_once(spark):
    table = ["85㎡ 이하 300만원 250만원", "102㎡ 이하 600만원 400만원", "135㎡ 이하 1,000만원 700만원", "모든 면적 1,500만원 1,000만원", "85㎡ 초과 가점 40% 추첨 60%", "60㎡ 초과 가점 50% 추첨 40%"]
    docs = [table, table[:3], [*table, "85㎡ 이하 9만원 9만원"], [*table, "70㎡ 이하 1만원 1만원"], [*table[:3], "모든 면적 1,500만원"], [None, "85㎡ 이하"]]
    lines = spark.createDataFrame([(i, 1, n, t) for i, d in enumerate(docs) for n, t in enumerate(d)], "doc int, page int, line int, text string")
    out, bands = tables.deposit_table(lines, ["doc"]), tables.allocation_bands(lines, ["doc"])
    tiers = [(None, [15_000_000, 10_000_000]), (85, [3_000_000, 2_500_000]), (102, [6_000_000, 4_000_000]), (135, [10_000_000, 7_000_000])]
    assert {r.doc: [(t.max_area, t.amounts) for t in r.tiers] for r in out.collect()} == {0: tiers, 2: tiers}
    assert {tuple(r) for r in bands.collect()} == {(i, 85, None, 40, 60) for i in (0, 2, 3)}
    assert [plan(x).count("Exchange hashpartitioning") for x in (out, bands, out.join(bands.hint("merge"), "doc"))] == [1, 1, 2]


def test_pages_without_a_day_are_not_dealt(spark):
    from noticeloom.operators import documents

    own, first = "본 주택의 2회차 입주자모집공고일은 2026.01.0", "이 주택의 최초 입주자모집공고일은 2026.02.0"
    pages = [(1, 1, first + "1"), (1, 2, own + "2"), (1, 3, own + "3"), (2, 9, own + "4"), (2, 8, first + "5"), (3, 1, "일정 2026.01.05"), (4, 1, None), (4, None, own + "6"), (None, 1, own + "7")]
    frame = spark.createDataFrame(pages, "notice_id int, page int, text string").withColumn("method", F.lit(None).cast("string"))
    out = documents.cutoffs(frame, "method", of=frame)
    assert {(r.notice_id, str(r.day), r.page) for r in out.collect()} == {(1, "2026-01-02", 2), (2, "2026-02-05", 8), (None, "2026-01-07", 1)}
    text = plan(out)
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text and "Window" not in text
