"""Facts as of each rule's day, whole records of a catalogue, and the fields that decide most."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions.text import unit_key
from noticeloom.operators.leaves import TESTS, with_facts
from noticeloom.operators.records import deciding, records
from noticeloom.operators.rules import evaluate, nodes
from noticeloom.operators.timeline import SNAPSHOTS, dated, dated_nodes, history_days, history_questions, with_history
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table

TODAY = date(2001, 6, 30)


DATED_SQL = """WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS n, CAST(DATE '2001-01-07' + 7 * CAST(n_nationkey AS INTEGER) AS DATE) AS announced FROM nation),
m AS (SELECT n, CASE WHEN n % 4 = 1 THEN CASE WHEN n % 8 = 1 THEN announced + 7 ELSE announced END WHEN n % 3 = 0 THEN announced - 7 ELSE announced END AS d FROM n),
c AS (SELECT c_custkey AS profile_id, CAST(floor(c_acctbal) AS BIGINT) AS income, CAST(DATE '2001-01-07' + 7 * CAST(c_custkey % 20 AS INTEGER) AS DATE) AS s, c_mktsegment <> 'BUILDING' AS homeless,
  CAST(DATE '2001-02-01' + CAST(c_custkey % 20 AS INTEGER) AS DATE) AS moved, CASE WHEN c_custkey % 2 = 0 THEN DATE '2001-02-11' ELSE DATE '2001-02-10' END AS seen FROM customer)"""


def _dated(spark, d):
    """Nodes of three rules for each nation's notice, with their days, and customers with their history."""
    n = F.col("n_nationkey").cast("int")
    announced = F.date_add(F.lit(date(2001, 1, 7)), 7 * n)
    places = table(spark, d, "nation").select(n.alias("n"), announced.alias("announced"))
    unranked = F.col("n") % 4 == 1
    notices = places.select(
        F.col("n").alias("notice_id"), "announced", F.when(F.col("n") % 3 == 0, F.date_sub("announced", 7)).alias("original"), F.lit(None).cast("date").alias("contract"),
        F.when(unranked, "unranked_after").otherwise("unknown").alias("method"), F.when(F.col("n") % 8 == 1, F.date_add("announced", 7)).alias("method_day"),
    )
    income = '{"kind":"monthly_income_max_krw","value":3000,"verification":"official","criterion_basis":"%s"}'
    texts = {"A-": income % "announcement", "B-": income % "application_date", "C-": '{"kind":"homeless","verification":"official","criterion_date":"2001-02-11"}'}
    listed = F.array(*[F.struct(F.concat(F.lit(k), F.col("n").cast("string")).alias("rule_id"), F.lit(v).alias("rule")) for k, v in texts.items()])
    rules = places.select(F.col("n").alias("notice_id"), F.inline(listed))
    key = F.col("c_custkey")
    snapshot = F.struct(
        F.lit("income").alias("group"), F.date_add(F.lit(date(2001, 1, 7)), (7 * (key % 20)).cast("int")).alias("day"),
        F.when(key % 5 < 4, F.array(F.lit("monthly_income"))).otherwise(F.array(F.lit("income"))).alias("held"),
        F.from_json(F.to_json(F.struct((F.floor("c_acctbal") - 2000).alias("monthly_income"))), SNAPSHOTS.split("facts:")[1].removesuffix(">>")).alias("facts"),
    )
    known = lambda group, mode, day: F.struct(F.lit(group).alias("group"), F.lit(mode).alias("mode"), day.cast("date").alias("day"))
    homes = F.when(key % 3 == 0, known("ownership", "never_changed", F.lit(None))).when(key % 3 == 1, known("ownership", "known", F.date_add(F.lit(date(2001, 2, 1)), (key % 20).cast("int"))))
    since = F.when(key % 4 == 0, known("income", "known", F.lit(date(2001, 3, 1))))
    second = F.lit(date(2001, 2, 11))
    seen = F.struct(F.lit("ownership").alias("group"), F.when(key % 2 == 0, second).otherwise(F.date_sub(second, 1)).alias("day"), F.array().cast("array<date>").alias("alike"), (key % 5 == 0).alias("since"))
    people = table(spark, d, "customer").select(
        key.alias("profile_id"), F.floor("c_acctbal").alias("monthly_income"), (F.col("c_mktsegment") != "BUILDING").alias("homeless"), F.lit(TODAY).alias("judged_on"),
        F.array(snapshot).alias("fact_snapshots"), F.array_compact(F.array(homes, since)).alias("fact_changes"), F.array(seen).alias("fact_observations"),
    )
    return dated_nodes(nodes(rules.select("rule_id", "rule")), rules, notices, F.lit(TODAY)), with_history(with_facts(people))


@query(f"""{DATED_SQL}, a AS (SELECT profile_id, 'A-' || n AS rule_id, CASE WHEN d = s THEN CASE WHEN profile_id % 5 < 4 THEN income - 2000 ELSE income END WHEN profile_id % 4 = 0 AND d >= DATE '2001-03-01' THEN income END <= 3000 AS ok FROM c, m),
b AS (SELECT profile_id, 'B-' || n AS rule_id, income <= 3000 AS ok FROM c, n),
h AS (SELECT profile_id, 'C-' || n AS rule_id, CASE WHEN profile_id % 3 = 0 THEN homeless WHEN profile_id % 3 = 1 AND moved <= DATE '2001-02-11' THEN homeless
  WHEN profile_id % 3 = 2 AND (seen = DATE '2001-02-11' OR profile_id % 5 = 0) THEN homeless END AS ok FROM c, n)
SELECT profile_id, rule_id, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'fail' ELSE 'review' END AS result FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM h)""")
def facts_at_rule_days(spark, d):
    """Three rules of a notice on three days: that of its announcement (or of its method), today, and one that the rule names.

    Incomes have a snapshot of one day and, for some, a day since which they are the same; homes have changed never, since a day, or
    were observed on one.
    """
    own, people = _dated(spark, d)
    return evaluate(own, people, ["profile_id"], *dated(F.lit(TODAY))).select("profile_id", "rule_id", "result")


@query(f"""{DATED_SQL} SELECT profile_id, 'income' AS "group", 'dual_income,monthly_income,income' AS facts, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS days FROM c, (SELECT DISTINCT d FROM m)
  WHERE NOT (d = s OR (profile_id % 4 = 0 AND d >= DATE '2001-03-01')) GROUP BY profile_id
UNION ALL SELECT profile_id, 'ownership', 'homeless,homes', '2001-02-11' FROM c WHERE CASE profile_id % 3 WHEN 0 THEN false WHEN 1 THEN moved > DATE '2001-02-11' ELSE seen <> DATE '2001-02-11' AND profile_id % 5 > 0 END""")
def open_history(spark, d):
    """Of each applicant the groups of facts that rules ask of former days of which nothing is known."""
    own, people = _dated(spark, d)
    today = F.lit(TODAY)
    rows = history_questions(people, ["profile_id"], history_days(own, today), today)
    return rows.select("profile_id", "group", F.array_join("facts", ",").alias("facts"), F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days"))


RECORDS_SQL = """WITH p AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 2 = 0 THEN 'near' ELSE 'far' END AS area, CASE WHEN c_custkey % 6 = 0 THEN 'review' WHEN floor(c_acctbal) <= 3000 THEN 'pass' ELSE 'fail' END AS a,
  CASE WHEN c_nationkey % 3 = 1 OR (c_mktsegment <> 'BUILDING' AND c_nationkey % 2 = 1) THEN 'fail' WHEN c_nationkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN 'pass' ELSE 'review' END AS b,
  CASE WHEN c_custkey % 10 = 3 OR c_custkey % 97 >= 78 THEN 'review' WHEN 2001 - year(CAST(DATE '1950-03-01' + INTERVAL 8 MONTH * CAST(c_custkey % 97 AS INT) AS DATE)) >= 30 THEN 'pass' ELSE 'fail' END AS c FROM customer),
combos AS (SELECT CAST(n_nationkey AS INTEGER) AS n, pos, supply, unit FROM nation, (VALUES (0, '신혼부부', '84A'), (1, '신혼부부', '59B'), (2, '일반공급', '84A'), (3, '일반공급', '59B'), (4, '생애최초', '59B')) AS v(pos, supply, unit)),
j AS (SELECT profile_id, n, pos, supply, unit, a, CASE WHEN supply = '신혼부부' THEN b END AS b, CASE WHEN unit = '59B' THEN c END AS c,
  supply = '일반공급' AND ((n % 3 = 0 AND area = 'near' AND unit = '84A') OR (n % 7 = 0 AND area = 'far')) AS closed FROM p, combos),
s AS (SELECT profile_id, n, pos, supply, unit, closed, CASE WHEN n % 5 < 4 THEN a END AS a, CASE WHEN n % 5 < 4 THEN b END AS b, CASE WHEN n % 5 < 4 THEN c END AS c,
  CASE WHEN closed THEN 'mismatch' WHEN n % 5 = 4 THEN 'unpublished' WHEN 'fail' IN (a, coalesce(b, ''), coalesce(c, '')) THEN 'mismatch' WHEN 'review' IN (a, coalesce(b, ''), coalesce(c, '')) THEN 'review' ELSE 'possible' END AS status FROM j),
r AS (SELECT *, concat_ws(',', 'A-' || n || '=' || a, 'B-' || n || '=' || b, 'C-' || n || '=' || c) AS reasons FROM s)"""
TEXT_SQL = f"""{RECORDS_SQL}, g AS (SELECT profile_id, n, supply, status, closed, reasons, string_agg(unit, '+' ORDER BY pos) AS units, min(pos) AS pos FROM r GROUP BY ALL),
gs AS (SELECT profile_id, n, string_agg(supply || ':' || status || ':' || closed || ':' || reasons || ':' || units, '|' ORDER BY supply <> '일반공급', pos) AS groups FROM g GROUP BY ALL),
x AS (SELECT profile_id, n, supply, unnest(string_split(reasons, ',')) AS reason FROM r WHERE reasons <> ''),
xs AS (SELECT profile_id, n, string_agg(reason, ',' ORDER BY reason) AS shared FROM (SELECT profile_id, n, reason FROM x GROUP BY ALL HAVING count(DISTINCT supply) > 1) GROUP BY ALL),
q AS (SELECT profile_id, n, unnest(CASE WHEN a = 'review' THEN ['monthly_income'] ELSE [] END || CASE WHEN b = 'review' THEN ['marital_status', 'homes'] ELSE [] END || CASE WHEN c = 'review' THEN ['birth'] ELSE [] END) AS field FROM r WHERE status = 'review'),
qs AS (SELECT profile_id, n, string_agg(field || '=' || k, ',' ORDER BY k DESC, field) AS questions FROM (SELECT profile_id, n, field, count(*) AS k FROM q GROUP BY ALL) GROUP BY ALL),
t AS (SELECT profile_id, n, CASE WHEN bool_or(status = 'possible') THEN 'possible' WHEN bool_and(status = 'mismatch') THEN 'mismatch' WHEN bool_and(status = 'unpublished') THEN 'unpublished' ELSE 'review' END AS status, CAST(count(*) FILTER (WHERE status = 'review') AS INTEGER) AS n_open FROM r GROUP BY ALL)
SELECT profile_id, n AS notice_id, status, groups, coalesce(shared, '') AS shared, coalesce(questions, '') AS questions, n_open FROM t JOIN gs USING (profile_id, n) LEFT JOIN xs USING (profile_id, n) LEFT JOIN qs USING (profile_id, n)"""


def _records(spark, d):
    """Customers as applicants, nations as notices of five combinations; a fifth of the notices has no rules."""
    places = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n"))
    units = [(0, "신혼부부", "84A"), (1, "신혼부부", "59B"), (2, "일반공급", "84A"), (3, "일반공급", "59B"), (4, "생애최초", "59B")]
    listed = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(s).alias("supply_type"), F.lit(u).alias("unit_type")) for p, s, u in units])
    combinations = places.select(F.col("n").alias("notice_id"), F.inline(listed))
    texts = (
        ("A-", None, None, '{"kind":"monthly_income_max_krw","value":3000,"verification":"official"}'),
        ("B-", "신혼부부", None, '{"kind":"all","verification":"official","conditions":[{"kind":"marital_status","value":"married"},{"kind":"homeless"}]}'),
        ("C-", None, "59B", '{"kind":"age_min","value":30,"verification":"official"}'),
    )
    told = F.array(*[F.struct(F.concat(F.lit(k), F.col("n").cast("string")).alias("rule_id"), F.lit(s).cast("string").alias("supply_type"), F.lit(u).cast("string").alias("unit_type"), F.lit(v).alias("rule")) for k, s, u, v in texts])
    rules = places.filter(F.col("n") % 5 < 4).select(F.col("n").alias("notice_id"), F.inline(told)).withColumn("unit_types", F.lit(None).cast("array<string>"))
    closed = F.array(
        F.when(F.col("n") % 3 == 0, F.struct(F.lit("near").alias("area"), F.array(unit_key(F.lit("84A"))).alias("closed_units"), F.lit(False).alias("all_closed"))),
        F.when(F.col("n") % 7 == 0, F.struct(F.lit("far").alias("area"), F.array().cast("array<string>").alias("closed_units"), F.lit(True).alias("all_closed"))),
    )
    closures = places.select(F.col("n").alias("notice_id"), F.inline(F.array_compact(closed)))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    people = table(spark, d, "customer").select(
        key.alias("profile_id"), F.when(key % 2 == 0, "near").otherwise("far").alias("area"), F.when(key % 6 > 0, F.floor("c_acctbal")).alias("monthly_income"),
        F.when(nation % 3 == 0, "married").when(nation % 3 == 1, "single").alias("marital_status"), F.when(F.col("c_mktsegment") != "BUILDING", nation % 2 == 0).alias("homeless"),
        F.when(key % 10 != 3, F.add_months(F.lit(date(1950, 3, 1)), (8 * (key % 97)).cast("int"))).alias("birth"), F.lit(date(2001, 12, 31)).alias("judged_on"),
    )
    return records(with_facts(people), ["profile_id"], combinations, rules, nodes(rules.select("rule_id", "rule")), TESTS, closures)


@query(TEXT_SQL)
def whole_records(spark, d):
    """A row for each applicant and notice with all that a screen shows, written as text."""
    reason = lambda r: F.concat(r["rule_id"], F.lit("="), r["result"])
    group = lambda g: F.concat_ws(":", g["supply_type"], g["status"], g["closed"].cast("string"), F.array_join(F.transform(g["reasons"], reason), ","), F.array_join(g["units"], "+"))
    question = lambda q: F.concat(q["field"], F.lit("="), q["n_combinations"].cast("string"))
    return _records(spark, d).select(
        "profile_id", "notice_id", "status", F.array_join(F.transform("groups", group), "|").alias("groups"), F.array_join(F.transform("shared_reasons", reason), ",").alias("shared"),
        F.array_join(F.transform("questions", question), ",").alias("questions"), "n_open",
    )


@query(f"""{RECORDS_SQL}, q AS (SELECT profile_id, n, unnest(CASE WHEN a = 'review' THEN ['monthly_income:income'] ELSE [] END || CASE WHEN b = 'review' THEN ['marital_status:family', 'homes:ownership'] ELSE [] END || CASE WHEN c = 'review' THEN ['birth:person'] ELSE [] END) AS f FROM r WHERE status = 'review')
SELECT string_split(f, ':')[1] AS field, string_split(f, ':')[2] AS facts, count(*) AS n_combinations, count(DISTINCT (profile_id, n)) AS n_records, row_number() OVER (ORDER BY count(*) DESC, string_split(f, ':')[1]) AS place FROM q GROUP BY f""")
def deciding_fields(spark, d):
    """Over all applicants and notices: which answers open combinations wait for, those that decide most first."""
    return deciding(_records(spark, d))
