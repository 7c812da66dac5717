"""Facts of former days and whole records at their edges."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.operators.leaves import TESTS, with_facts
from noticeloom.operators.records import records
from noticeloom.operators.rules import evaluate, nodes
from noticeloom.operators.timeline import dated, dated_nodes, history_days, history_questions, source_at, with_history

D = date
TODAY = D(2026, 6, 30)


def test_what_tells_the_facts_of_a_day(spark):
    kinds = "id int, day date, fact_snapshots array<struct<group:string,day:date,held:array<string>>>, fact_changes array<struct<group:string,mode:string,day:date>>, fact_observations array<struct<group:string,day:date,alike:array<date>,since:boolean>>"
    past = D(2026, 1, 10)
    snap = lambda g, d, held: [(g, d, held)]
    rows = [
        (1, None, [], [], []), (2, TODAY, [], [], []), (3, D(2027, 1, 1), [], [], []), (4, past, [], [], []),
        (5, past, snap("income", past, ["income"]), [], []), (6, past, snap("income", D(2026, 1, 11), ["income"]), [], []), (7, past, snap("income", past, []), [], []), (8, past, snap("assets", past, ["assets"]), [], []),
        (9, past, [], [("income", "never_changed", None)], []), (10, past, [], [("income", "known", past)], []), (11, past, [], [("income", "known", D(2026, 1, 11))], []), (12, past, [], [("income", "unknown", past)], []), (13, past, [], [("income", "known", None)], []),
        (14, past, [], [], [("income", past, [], False)]), (15, past, [], [], [("income", D(2025, 1, 1), [past], False)]), (16, past, [], [], [("income", D(2025, 1, 1), [], True)]), (17, past, [], [], [("income", D(2026, 2, 1), [], True)]),
        (18, past, [], [("income", "unknown", None)], [("income", past, [], True)]), (19, past, snap("income", past, ["income"]), [("income", "known", D(2026, 3, 1))], []),
    ]
    got = {r.id: r.s for r in spark.createDataFrame(rows, kinds).select("id", source_at("income", F.col("day"), F.lit(TODAY)).alias("s")).collect()}
    want = {1: "unknown", 2: "current", 3: "current", 4: "unknown", 5: "snapshot", 6: "unknown", 7: "unknown", 8: "unknown", 9: "unchanged", 10: "unchanged", 11: "unknown", 12: "unknown", 13: "unknown", 14: "observed", 15: "observed", 16: "observed", 17: "unknown", 18: "unknown", 19: "snapshot"}
    assert got == want


def test_one_applicant_two_days(spark):
    rule = '{"kind":"%s","value":%s,"verification":"official","criterion_date":"%s"}'
    texts = [("then", rule % ("children_min", 2, "2026-01-10")), ("now", rule % ("children_min", 2, "2026-06-30")), ("between", rule % ("children_min", 2, "2026-03-01")), ("bad", rule % ("children_min", 2, "2026-02-30")), ("age", rule % ("age_min", 30, "2026-01-10"))]
    rules = spark.createDataFrame([(k, 1, t) for k, t in texts], "rule_id string, notice_id int, rule string")
    notices = spark.createDataFrame([(1, None, None, None, "unknown", None)], "notice_id int, announced date, original date, contract date, method string, method_day date")
    own = dated_nodes(nodes(rules), rules, notices, F.lit(TODAY))
    facts = "struct<children:array<date>,expected_children:int>"
    people = spark.createDataFrame([(7, [D(2020, 1, 1), D(2021, 1, 1)], 0, D(1996, 1, 10), [("children", D(2026, 1, 10), ["children"], ([D(2020, 1, 1)], None))])], f"profile_id int, children array<date>, expected_children int, birth date, s array<struct<group:string,day:date,held:array<string>,facts:{facts}>>")
    from noticeloom.operators.timeline import SNAPSHOTS

    people = people.withColumn("fact_snapshots", F.from_json(F.to_json("s"), SNAPSHOTS)).drop("s")
    full = with_history(with_facts(people))
    got = {r.rule_id: r.result for r in evaluate(own, full, ["profile_id"], *dated(F.lit(TODAY))).collect()}
    assert got == {"then": "fail", "now": "pass", "between": "review", "bad": "review", "age": "pass"}
    asked = history_questions(full, ["profile_id"], history_days(own, F.lit(TODAY)), F.lit(TODAY)).collect()
    assert [(r.group, r.facts, r.days) for r in asked] == [("children", ["children", "expected_children"], [D(2026, 3, 1)])]


def test_records_in_passes_are_the_same(spark):
    rule = '{"kind":"%s","value":%s,"verification":"official"}'
    rules = [(n, f"{k}{n}", s, u, None, rule % (k, 2)) for n in range(6) for k, s, u in (("children_min", None, None), ("household_min", "특별", None), ("ownership_count_max", None, "A"))]
    rules = spark.createDataFrame(rules, "notice_id int, rule_id string, supply_type string, unit_type string, unit_types array<string>, rule string")
    combos = spark.createDataFrame([(n, p, s, u) for n in range(7) for p, (s, u) in enumerate([("특별", "A"), ("특별", "B"), ("일반", "A"), (None, "B")])], "notice_id int, pos int, supply_type string, unit_type string")
    closed = spark.createDataFrame([(0, "x", ["A"], False), (1, "y", [], True)], "notice_id int, area string, closed_units array<string>, all_closed boolean")
    people = with_facts(spark.createDataFrame([(1, "x", 3, 1), (2, "y", 2, None), (3, None, None, None)], "profile_id int, area string, household_size int, homes int").withColumn("children", F.when(F.col("profile_id") == 1, F.array(F.lit(D(2020, 1, 1)), F.lit(D(2021, 1, 1))))).withColumn("judged_on", F.lit(TODAY)))
    own = nodes(rules.select("rule_id", "rule"))
    whole, parts = (sorted(map(repr, records(people, ["profile_id"], combos, rules, own, TESTS, closed, block_nodes=b).collect())) for b in (5000, 4))
    assert whole == parts and len(whole) == 21
    by = {(r.profile_id, r.notice_id): r for r in records(people, ["profile_id"], combos, rules, own, TESTS, closed).collect()}
    assert by[1, 6].status == "unpublished" and [g.status for g in by[1, 6].groups] == ["unpublished"] * 3 and by[1, 6].groups[0].supply_type == "일반"
    assert by[1, 2].status == "possible" and [(g.supply_type, g.units) for g in by[1, 2].groups] == [("일반", ["A"]), ("특별", ["A"]), ("특별", ["B"]), (None, ["B"])]
    assert by[1, 0].groups[0].closed and by[1, 0].groups[0].status == "mismatch" and not by[2, 0].groups[0].closed and by[2, 1].groups[0].closed
    assert [(q.field, q.n_combinations) for q in by[3, 2].questions] == [("children", 4), ("homes", 2), ("members", 2)] and by[3, 2].n_open == 4
    assert records(people.limit(0), ["profile_id"], combos, rules, own, TESTS, closed).count() == 0


def test_applicants_are_dealt_out_and_their_rules_judged_once(spark):
    rule = '{"kind":"%s","value":%s,"verification":"official"}'
    rules = spark.createDataFrame([(f"{k}{n}", rule % (k, 2)) for n in range(5) for k in ("children_min", "household_min")], "rule_id string, rule string")
    people = with_facts(spark.range(3).select(F.col("id").alias("profile_id"), F.col("id").cast("int").alias("household_size"))).coalesce(1)
    got = evaluate(nodes(rules), people, ["profile_id"], TESTS)
    assert got.rdd.getNumPartitions() > 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "size(transform" not in plan and "isnotnull(transform" not in plan  # no filter computes the results again
    assert sorted((r.profile_id, r.rule_id, r.result) for r in got.collect()) == sorted(
        (p, f"{k}{n}", "review" if k == "children_min" else "pass" if p >= 2 else "fail") for p in range(3) for n in range(5) for k in ("children_min", "household_min"))


def test_coverage_when_combinations_are_computed_anew(spark):
    """Each computation of the combinations has the rows in another order, as after a shuffle."""
    from noticeloom.operators.validity import scope_coverage

    own = [(n, u, s) for n in range(40) for u in ("A", None) for s in ("x", "y")]
    combos = spark.createDataFrame(own, "notice_id int, unit_type string, supply_type string").repartition(8).orderBy(F.rand())
    scopes = spark.createDataFrame([(n, None, None, n % 2 == 0, True, [f"t{n}"]) for n in range(40)], "notice_id int, unit_type string, supply_type string, official boolean, complete boolean, missing_topics array<string>")
    rules = spark.createDataFrame([(n, None, None, "official") for n in range(40) for _ in range(n)], "notice_id int, unit_type string, supply_type string, verification string")
    got = scope_coverage(combos, scopes, rules).collect()
    plan = scope_coverage(combos, scopes, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan  # ids made while running aren't the same in each computation
    assert len(got) == len(own) and all((r.complete, r.verified_count, r.missing_topics) == (r.notice_id % 2 == 0, r.notice_id, [f"t{r.notice_id}"]) for r in got)
