"""Combinations, closures, summaries, questions; polls; tables of documents."""

import json

from pyspark.sql import functions as F

from noticeloom.operators.evaluation import brief, catalogue, judged_combinations, opportunities, polled_rules, questions, shared_reasons, summaries, with_closures
from noticeloom.operators.rules import nodes
from noticeloom.operators.tables import allocation_bands, deposit_table, supplies


def test_catalogue(spark):
    pairs = spark.createDataFrame([(1, "일반공급", "084.9A"), (1, "일반공급", "059.9"), (1, "다자녀", None)], "notice_id int, supply_type string, unit_type string")
    rules = spark.createDataFrame([(1, "r1", None, None, None), (1, "r2", "일반공급", "84.9a", None), (1, "r3", "다자녀", None, None), (1, "r4", None, None, ["0599"]), (9, "r5", None, None, None)], "notice_id int, rule_id string, supply_type string, unit_type string, unit_types array<string>")
    rules = rules.withColumn("unit_type", F.when(F.col("unit_type").isNotNull(), "084.9a"))
    results = spark.createDataFrame([("p", "r1", "pass"), ("p", "r2", "pass"), ("p", "r3", "fail"), ("p", "r4", "review")], "profile_id string, rule_id string, result string")
    judged = judged_combinations(pairs, rules, results)
    got = {(r.supply_type, r.unit_type): (r.status, [x.rule_id for x in r.reasons]) for r in judged.collect()}
    # A combination of the whole notice has no unit: rules of single units don't speak against it, lists of units leave it open.
    assert got[("일반공급", "084.9A")] == ("possible", ["r1", "r2"]) and got[("일반공급", "059.9")][0] == "review" and got[("다자녀", None)][0] == "mismatch"
    closed = spark.createDataFrame([("p", 1, ["0849A"], False)], "profile_id string, notice_id int, closed_units array<string>, all_closed boolean")
    after = with_closures(judged, closed)
    assert {(r.supply_type, r.unit_type): r.status for r in after.collect()}[("일반공급", "084.9A")] == "mismatch"
    assert {r.status for r in summaries(judged).filter("general").collect()} == {"possible", "review"}
    assert [(r.rule_id, r.n_supplies) for r in shared_reasons(judged).collect()][0] == ("r1", 2)
    notices = spark.createDataFrame([(1,), (2,)], "id int")
    assert sorted((r.notice_id, r.profile_id, r.status) for r in catalogue(judged, notices).collect()) == [(1, "p", "possible"), (2, None, "unpublished")]
    reasons = spark.createDataFrame([([("a", "pass"), ("b", "pass"), ("c", "review"), ("d", "fail")],)], "r array<struct<rule_id:string,result:string>>")
    assert [x.rule_id for x in reasons.select(brief(F.col("r")).alias("b")).first().b] == ["d", "a", "c"]


def test_questions(spark):
    rule = {"kind": "all", "conditions": [{"kind": "children_min"}, {"kind": "any", "conditions": [{"kind": "age_min"}, {"kind": "newborn_children_min"}]}]}
    got = questions(nodes(spark.createDataFrame([("x", json.dumps(rule))], "rule_id string, rule string"))).collect()
    assert sorted((r.field, r.n_rules) for r in got) == [("birth", 1), ("children", 2)]


def test_polls_and_opportunities(spark):
    kind = "notice_id int, kind string, metadata boolean, document_hash string, verification string, original_date date, rule string"
    prior = spark.createDataFrame([(1, "ctx", True, None, "official", None, "old"), (1, "ctx", True, "h", "official", None, "doc"), (1, "age_min", False, None, "official", None, "keep"), (1, "other", True, None, "official", None, "stay")], kind).withColumn("original_date", F.lit("2026-01-01").cast("date"))
    new = spark.createDataFrame([(1, "ctx", True, None, "official", None, "new")], kind).withColumn("original_date", F.lit("2026-02-01").cast("date"))
    got = {r.rule: str(r.original_date) for r in polled_rules(prior, new).collect()}
    assert set(got) == {"doc", "keep", "stay", "new"} and got["new"] == "2026-01-01"
    methods = spark.createDataFrame([(1, "A", "일반", "가점", 40, "local", True), (1, "B", "일반", "가점", 40, "local", True), (1, "A", "특별", "가점", 40, "local", True), (1, "C", "일반", "가점", 40, "local", False)], "notice_id int, unit_type string, supply_type string, method string, ratio int, area string, official boolean")
    scores = spark.createDataFrame([(1, "a", "local", 50, 60), (1, "B", "local", 51, 60)], "notice_id int, unit_type string, area string, minimum int, average int")
    out = {r.supply_type: (r.units, r.minimum, r.average) for r in opportunities(methods, scores).collect()}
    assert out == {"일반": (["A", "B"], None, 60), "특별": (["A"], 50, 60)}


def test_tables(spark):
    text = ["전용 85㎡ 이하 300만원 250만원", "102㎡ 이하 600만원 400만원", "135㎡ 이하 1,000만원 700만원", "모든 면적 1,500만원 1,000만원", "60㎡ 초과 85㎡ 이하 가점 40% 추첨 60%", "85㎡ 초과 가점 50% 추첨 60%"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(text)] + [(2, 1, i, t) for i, t in enumerate(text[1:4])], "doc int, page int, line int, text string")
    got = deposit_table(lines, ["doc"]).collect()
    assert [r.doc for r in got] == [1] and sorted((t.max_area or 0, t.amounts) for t in got[0].tiers) == [(0, [15_000_000, 10_000_000]), (85, [3_000_000, 2_500_000]), (102, [6_000_000, 4_000_000]), (135, [10_000_000, 7_000_000])]
    assert [(r.low, r.high, r.points) for r in allocation_bands(lines, ["doc"]).collect()] == [(60, 85, 40)]
    rows = spark.createDataFrame([(1, 0, "84.9500A", ["1", "2", "-", "0", "0", "0", "1,000", "1,003"]), (1, 1, "59.9500", ["0"] * 6 + ["5", "5"]), (2, 0, "84.9500A", ["1"] * 8), (2, 1, "59.9500", ["0"] * 6 + ["5", "5"])], "doc int, row int, unit string, counts array<string>")
    assert sorted((r.doc, r.unit_type, r.supply_type, r.supply_count) for r in supplies(rows, ["doc"]).collect()) == [(1, "059.9500", "일반", 5), (1, "084.9500A", "기관추천", 1), (1, "084.9500A", "다자녀", 2), (1, "084.9500A", "일반", 1000)]
