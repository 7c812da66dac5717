"""Rules judged for many applicants at once, lookups, ages, months and points."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions.dates import age_at, full_months, recognised_months
from noticeloom.operators.consensus import notice_status, status_of
from noticeloom.operators.leaves import TESTS, with_facts
from noticeloom.operators.lookups import band, sized, tier
from noticeloom.operators.points import account_points, dependant_points, homeless_points, totals
from noticeloom.operators.rules import evaluate, nodes
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table

DAY = date(2002, 3, 31)


@query("""WITH units AS (SELECT l_orderkey AS notice_id, l_returnflag AS supply,
    CASE WHEN count(*) FILTER (WHERE l_quantity < 5) > 0 THEN 'mismatch' WHEN count(*) FILTER (WHERE l_quantity < 20) > 0 THEN 'review' ELSE 'possible' END AS status
  FROM lineitem GROUP BY 1, 2)
SELECT notice_id, CASE WHEN count(*) FILTER (WHERE status = 'possible') > 0 THEN 'possible' WHEN bool_and(status = 'mismatch') THEN 'mismatch' ELSE 'review' END AS status, count(*) AS n FROM units GROUP BY notice_id""")
def status_fold_kleene(spark, d):
    judged = F.when(F.col("l_quantity") < 5, "fail").when(F.col("l_quantity") < 20, "review").otherwise("pass")
    units = table(spark, d, "lineitem").withColumn("judged", judged).groupBy(F.col("l_orderkey").alias("notice_id"), "l_returnflag").agg(status_of(F.col("judged")).alias("status"))
    return units.groupBy("notice_id").agg(notice_status(F.col("status")).alias("status"), F.count(F.lit(1)).alias("n"))


RULES = [
    ("r1", """{"kind":"all","verification":"official","conditions":[{"kind":"balance","operator":">=","value":1000},{"kind":"any","conditions":[{"kind":"segment","value":"BUILDING"},{"kind":"nation_max","operator":"<=","value":12}]}]}"""),
    ("r2", """{"kind":"balance","operator":">=","value":5000,"verification":"official","exceptions":[{"kind":"segment","value":"MACHINERY"},{"kind":"unparsed"}]}"""),
    ("r3", """{"kind":"not","verification":"official","conditions":[{"kind":"segment","value":"HOUSEHOLD"}]}"""),
    ("r4", """{"kind":"all","verification":"official","conditions":[]}"""),
    ("r5", """{"kind":"condition_group","operator":"any","verification":"ai_unverified","conditions":[{"kind":"balance","operator":">","value":0}]}"""),
]


@query("""WITH c AS (SELECT c_custkey AS profile_id, c_acctbal >= 1000 AS b1, c_acctbal >= 5000 AS b5, c_mktsegment = 'BUILDING' AS sb, c_mktsegment = 'MACHINERY' AS sm, c_mktsegment = 'HOUSEHOLD' AS sh, c_nationkey <= 12 AS n FROM customer)
SELECT profile_id, 'r1' AS rule_id, CASE WHEN b1 AND (sb OR n) THEN 'pass' ELSE 'fail' END AS result FROM c
UNION ALL SELECT profile_id, 'r2', CASE WHEN sm OR b5 THEN 'pass' ELSE 'review' END FROM c
UNION ALL SELECT profile_id, 'r3', CASE WHEN sh THEN 'fail' ELSE 'pass' END FROM c
UNION ALL SELECT profile_id, 'r4', 'review' FROM c UNION ALL SELECT profile_id, 'r5', 'review' FROM c""")
def rule_tree_eval(spark, d):
    rules = nodes(spark.createDataFrame(RULES, "rule_id string, rule string"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    leaf = {
        "balance": lambda r: compare_number(F.col("balance"), r), "nation_max": lambda r: compare_number(F.col("nation").cast("double"), r),
        "segment": lambda r: F.col("segment") == r["value_text"],
    }
    return evaluate(rules, people, ["profile_id"], leaf).select("profile_id", "rule_id", "result")


LEAF_RULES = [
    ("age", """{"kind":"all","verification":"official","criterion_date":"2000-06-01","conditions":[{"kind":"age_min","value":30},{"kind":"age_max","operator":"<","value":50}]}"""),
    ("family", """{"kind":"any","verification":"official","conditions":[{"kind":"newborn_children_min","value":1},{"kind":"children_min","operator":">=","value":2},{"kind":"marital_status","value":"engaged, married"}]}"""),
    ("account", """{"kind":"all","verification":"official","conditions":[{"kind":"account_type","value":"comprehensive"},{"kind":"subscription_months","value":24},{"kind":"deposit_min_krw","value":3000}],"exceptions":[{"kind":"recommendation","value":"confirmed"}]}"""),
    ("home", """{"kind":"all","verification":"official","conditions":[{"kind":"homeless"},{"kind":"previous_winning","value":false},{"kind":"residence_region","value":"R"},{"kind":"residence_months","value":12}]}"""),
    ("unknown", """{"kind":"tax_years_min","value":5,"verification":"official"}"""),
]
FACTS = (
    "c_custkey AS profile_id", "CAST(DATE '1930-03-01' + INTERVAL 8 MONTH * CAST(c_custkey % 97 AS INT) AS DATE) AS birth", "c_custkey % 5 AS kids", "CASE c_nationkey % 3 WHEN 0 THEN 'married' WHEN 1 THEN 'single' END AS marital_status",
    "CASE WHEN c_custkey % 2 = 0 THEN 'comprehensive' ELSE 'deposit' END AS account_type", "CAST(DATE '1996-01-31' + INTERVAL 1 MONTH * CAST(c_custkey % 80 AS INT) AS DATE) AS account_since", "CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS deposit",
    "CASE WHEN c_custkey % 11 = 0 THEN 'confirmed' END AS recommendation", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey % 2 = 0 END AS homeless", "c_custkey % 7 = 0 AS previous_winning", "CAST(DATE '2000-01-15' + INTERVAL 1 MONTH * CAST(c_custkey % 20 AS INT) AS DATE) AS moved_in",
    "c_custkey % 3 > 0 AS near",
)


@query(f"""WITH f AS (SELECT {', '.join(FACTS)} FROM customer), t AS (
  SELECT *, 2000 - year(birth) - CASE WHEN (month(birth), day(birth)) > (6, 1) THEN 1 ELSE 0 END AS age, kids >= 3 AS two_kids, kids = 3 AS newborn,
    account_since <= DATE '2001-12-31' AS opened, CAST(account_since + INTERVAL 24 MONTH AS DATE) <= DATE '2001-12-31' AS two_years, CAST(moved_in + INTERVAL 12 MONTH AS DATE) <= DATE '2001-12-31' AS year_here FROM f)
SELECT profile_id, 'age' AS rule_id, CASE WHEN age >= 30 AND age < 50 THEN 'pass' ELSE 'fail' END AS result FROM t
UNION ALL SELECT profile_id, 'family', CASE WHEN newborn OR two_kids OR marital_status = 'married' THEN 'pass' WHEN marital_status IS NULL THEN 'review' ELSE 'fail' END FROM t
UNION ALL SELECT profile_id, 'account', CASE WHEN recommendation = 'confirmed' THEN 'pass' WHEN account_type <> 'comprehensive' OR (opened AND NOT two_years) OR deposit < 3000 THEN 'review' WHEN deposit IS NULL OR NOT opened THEN 'review' ELSE 'pass' END FROM t
UNION ALL SELECT profile_id, 'home', CASE WHEN NOT homeless OR previous_winning OR NOT near OR NOT year_here THEN 'fail' WHEN homeless IS NULL THEN 'review' ELSE 'pass' END FROM t
UNION ALL SELECT profile_id, 'unknown', 'review' FROM t""")
def profile_rules(spark, d):
    """Rules of many kinds by the library's tests of facts: ages, children, accounts, homes and residence, judged on 31 December 2001."""
    day_ = F.lit(date(2001, 12, 31))
    rules = nodes(spark.createDataFrame(LEAF_RULES, "rule_id string, rule string"))
    old, young = F.lit(date(1990, 1, 1)), F.lit(date(2001, 1, 1))
    kids = F.when(F.col("kids") == 3, F.array(old, young)).when(F.col("kids") > 3, F.array(old, old)).otherwise(F.array(old))
    people = table(spark, d, "customer").selectExpr(*FACTS).withColumns({"children": kids, "in_region": F.when(F.col("near"), F.array(F.lit("R"), F.lit("S"))).otherwise(F.array(F.lit("S"))), "judged_on": day_})
    return evaluate(rules, with_facts(people), ["profile_id"], TESTS).select("profile_id", "rule_id", "result")


def compare_number(value, rule):
    from noticeloom.operators.rules import compare

    return compare(value, rule["operator"], rule["value_number"])


@query("""SELECT c_custkey AS profile_id, c_nationkey * 7 AS area, CASE WHEN c_nationkey * 7 <= 85 THEN 3000000 WHEN c_nationkey * 7 <= 102 THEN 6000000 WHEN c_nationkey * 7 <= 135 THEN 10000000 ELSE 15000000 END AS required,
  c_acctbal * 2000 >= CASE WHEN c_nationkey * 7 <= 85 THEN 3000000 WHEN c_nationkey * 7 <= 102 THEN 6000000 WHEN c_nationkey * 7 <= 135 THEN 10000000 ELSE 15000000 END AS passes FROM customer""")
def tier_deposit_lookup(spark, d):
    area = F.col("c_nationkey") * 7
    required = tier(area, [(85, 3_000_000), (102, 6_000_000), (135, 10_000_000), (None, 15_000_000)])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), area.alias("area"), required.alias("required"), (F.col("c_acctbal") * 2000 >= required).alias("passes"))


@query("""SELECT c_custkey AS profile_id, CAST(CASE WHEN s <= 3 THEN 700 WHEN s = 4 THEN 820 WHEN s = 5 THEN 880 ELSE 880 + (s - 5) * 70 END AS INTEGER) AS most FROM (SELECT c_custkey, c_nationkey % 9 + 1 AS s FROM customer) AS x""")
def income_table_extrapolation(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), sized(F.col("c_nationkey") % 9 + 1, {3: 700, 4: 820, 5: 880}, 70).cast("int").alias("most"))


@query("""SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'middle' WHEN p_size > 30 THEN 'large' END AS method FROM part""")
def area_band_range_join(spark, d):
    return table(spark, d, "part").select("p_partkey", band(F.col("p_size"), [(0, 10, "small"), (10, 30, "middle"), (30, None, "large")]).alias("method"))


MONTHS_SQL = "((year(e) - year(s)) * 12 + month(e) - month(s))"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN s <= e THEN {MONTHS_SQL} - CASE WHEN e < CAST(s + to_months(CAST({MONTHS_SQL} AS INTEGER)) AS DATE) THEN 1 ELSE 0 END END AS INTEGER) AS months,
  CAST(CASE WHEN s <= DATE '2002-03-31' THEN 2002 - year(s) - CASE WHEN month(s) < 3 OR (month(s) = 3 AND day(s) <= 31) THEN 0 ELSE 1 END END AS INTEGER) AS age
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS s, CAST(l_shipdate AS DATE) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS x""")
def full_months_age(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return rows.select("l_orderkey", "l_linenumber", full_months(start, end).alias("months"), age_at(start, F.lit(DAY)).alias("age"))


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS opened, CAST(DATE '1979-01-01' + CAST((o_custkey * 13) % 7000 AS INTEGER) AS DATE) AS birth, DATE '2002-03-31' AS d FROM orders),
y AS (SELECT *, CAST(birth + INTERVAL 19 YEAR AS DATE) AS adult FROM x),
z AS (SELECT *, CASE WHEN opened >= adult THEN opened ELSE greatest(opened, CAST(least(least(adult, d), DATE '2024-01-01') - INTERVAL 24 MONTH AS DATE), CAST(least(adult, d) - INTERVAL 60 MONTH AS DATE)) END AS s, d AS e FROM y)
SELECT id, CAST(CASE WHEN birth <= opened AND opened <= d THEN (year(e) - year(s)) * 12 + month(e) - month(s) - CASE WHEN e < CAST(s + to_months(CAST((year(e) - year(s)) * 12 + month(e) - month(s) AS INTEGER)) AS DATE) THEN 1 ELSE 0 END END AS INTEGER) AS months FROM z""")
def account_months_capped(spark, d):
    birth = F.date_add(F.lit(date(1979, 1, 1)), ((F.col("o_custkey") * 13) % 7000).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), recognised_months(F.col("o_orderdate").cast("date"), birth, F.lit(DAY)).alias("months"))


@query("""WITH x AS (SELECT c_custkey AS profile_id, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal < 0 END AS owner, c_nationkey % 8 AS dependants, min(CAST(o_orderdate AS DATE)) AS s, DATE '2002-03-31' AS e
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_acctbal, c_nationkey),
m AS (SELECT *, CASE WHEN s <= e THEN (year(e) - year(s)) * 12 + month(e) - month(s) - CASE WHEN e < CAST(s + to_months(CAST((year(e) - year(s)) * 12 + month(e) - month(s) AS INTEGER)) AS DATE) THEN 1 ELSE 0 END END AS months FROM x),
p AS (SELECT profile_id, CAST(CASE WHEN owner THEN 0 WHEN owner IS NOT NULL AND s IS NOT NULL THEN least(32, (months // 12 + 1) * 2) END AS INTEGER) AS homeless, CAST(least(35, (dependants + 1) * 5) AS INTEGER) AS family,
  CAST(CASE WHEN months < 6 THEN 1 WHEN months < 12 THEN 2 WHEN months IS NOT NULL THEN least(17, months // 12 + 2) END AS INTEGER) AS account FROM m)
SELECT *, homeless + family + account AS total, CAST(coalesce(homeless, 0) + family + coalesce(account, 0) AS INTEGER) AS confirmed FROM p""")
def points_score(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("since"))
    rows = table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    owner = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") < 0)
    years = F.when(owner, 0).when(F.col("since").isNotNull(), homeless_points(F.col("since"), F.lit(DAY), owner))
    out = rows.select(F.col("c_custkey").alias("profile_id"), years.alias("homeless"), dependant_points(F.col("c_nationkey") % 8).alias("family"), account_points(full_months(F.col("since"), F.lit(DAY))).alias("account"))
    total, confirmed = totals(F.col("homeless"), F.col("family"), F.col("account"))
    return out.withColumn("total", total).withColumn("confirmed", confirmed)
