"""Regions, residence and days: nations as districts of five provinces, customers as people, orders as notices."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions import dates
from noticeloom.operators import regions
from noticeloom.operators.lookups import scope_keys
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table

PROVINCE = "CASE n_regionkey WHEN 0 THEN '11' WHEN 1 THEN '26' WHEN 2 THEN '41' WHEN 3 THEN '51' ELSE '36' END"
PROVINCE_NAME = "CASE n_regionkey WHEN 0 THEN '서울특별시' WHEN 1 THEN '부산' WHEN 2 THEN '경기도' WHEN 3 THEN '강원도' ELSE '세종시' END"
# The first nation of a region is a city; the last is an ordinary district of it, and newer than the others.
DISTRICTS = (
    f"{PROVINCE} || CAST(n_nationkey + 100 AS STRING) AS code", "n_name || '구' AS name", f"{PROVINCE} AS province_code",
    f"CASE WHEN n_nationkey >= 20 THEN {PROVINCE} || CAST(n_nationkey + 80 AS STRING) END AS parent_code", "CASE WHEN n_nationkey % 10 > 4 THEN DATE '1997-01-01' ELSE DATE '1990-01-01' END AS valid_from",
)
DISTRICTS_SQL = f"districts AS (SELECT {', '.join(DISTRICTS)} FROM nation)"


def districts(spark, d):
    return table(spark, d, "nation").selectExpr(*DISTRICTS)


CODES = ("c_custkey", f"CASE c_custkey % 9 WHEN 0 THEN {PROVINCE} WHEN 1 THEN {PROVINCE} || '000' WHEN 2 THEN {PROVINCE} || '00000000' WHEN 3 THEN {PROVINCE} || CAST(n_nationkey + 100 AS STRING) "
         f"WHEN 4 THEN ' ' || {PROVINCE} || CAST(n_nationkey + 100 AS STRING) || '00000' WHEN 5 THEN {PROVINCE} || CAST(n_nationkey + 100 AS STRING) || '00100' WHEN 6 THEN '99' WHEN 7 THEN 'x' END AS code")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 9 < 5 THEN {PROVINCE} END AS province, CASE WHEN c_custkey % 9 IN (3, 4) THEN {PROVINCE} || CAST(n_nationkey + 100 AS STRING) END AS district
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def region_codes(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*CODES)
    return regions.by_code(rows, "code", districts(spark, d), "place").select("c_custkey", "place.province", "place.district")


NAMES = ("c_custkey", f"{PROVINCE} AS home", f"CASE c_custkey % 10 WHEN 0 THEN {PROVINCE_NAME} WHEN 1 THEN {PROVINCE_NAME} || ' 전 지역' WHEN 2 THEN {PROVINCE_NAME} || ' ' || n_name || ' 구' WHEN 3 THEN n_name || '구' WHEN 4 THEN {PROVINCE_NAME} || '/인천' "
         "WHEN 5 THEN '전라남도' WHEN 6 THEN '서울 ' || n_name || '구' WHEN 7 THEN '광주' WHEN 8 THEN ' ' END AS name")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 10 < 4 THEN {PROVINCE} WHEN c_custkey % 10 = 6 AND n_regionkey = 0 THEN '11' END AS province,
  CASE WHEN c_custkey % 10 IN (2, 3) OR (c_custkey % 10 = 6 AND n_regionkey = 0) THEN {PROVINCE} || CAST(n_nationkey + 100 AS STRING) END AS district FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def region_names(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*NAMES)
    return regions.by_name(rows, "name", F.col("home"), districts(spark, d), "place").select("c_custkey", "place.province", "place.district")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN {PROVINCE} END AS region_code, CASE WHEN c_custkey % 5 = 1 THEN {PROVINCE} || CAST(n_nationkey + 100 AS STRING) END AS district_code,
  c_custkey % 5 IN (2, 3) AS needs_review FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def legacy_regions(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey", f"CASE c_custkey % 5 WHEN 3 THEN '어디' WHEN 4 THEN '' ELSE {PROVINCE_NAME} END AS region", "CASE c_custkey % 5 WHEN 1 THEN n_name || ' 구' WHEN 2 THEN 'x' WHEN 0 THEN ' ' END AS district",
    )
    return regions.resolve(rows, "region", "district", districts(spark, d)).select("c_custkey", "region_code", "district_code", "needs_review")


@query(f"""WITH {DISTRICTS_SQL}
SELECT '11' AS province, code, name FROM districts WHERE province_code = '11' AND parent_code IS NULL UNION ALL SELECT '26', code, name FROM districts WHERE province_code = '26'
UNION ALL SELECT '', unnest(['11', '12', '26', '27', '28', '30', '31', '36', '41', '43', '44', '47', '48', '50', '51', '52']), NULL""")
def region_options(spark, d):
    own = districts(spark, d)
    rows = regions.district_options(own, "11").select(F.lit("11").alias("province"), "code", "name").unionByName(regions.district_options(own, "26", ordinary=True).select(F.lit("26").alias("province"), "code", "name"))
    return rows.unionByName(regions.province_options(spark).select(F.lit("").alias("province"), "code", F.lit(None).cast("string").alias("name")))


@query(f"""WITH {DISTRICTS_SQL}, rows AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 6 AS k, h.province_code AS hp, h.code AS h, h.parent_code AS hparent, h.valid_from AS hfrom, t.province_code AS tp, t.code AS t, t.parent_code AS tparent, t.valid_from AS tfrom
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN districts AS h ON CAST(right(h.code, 3) AS INTEGER) = c_nationkey + 100 JOIN districts AS t ON CAST(right(t.code, 3) AS INTEGER) = o_orderkey % 25 + 100)
SELECT o_orderkey AS notice_id, CASE WHEN k = 5 THEN NULL WHEN day < hfrom AND hp <> '51' AND hparent IS NULL THEN NULL
  WHEN k = 0 THEN hp = tp WHEN k = 4 AND hp <> tp THEN NULL WHEN hp <> tp THEN FALSE WHEN tp = '36' THEN TRUE
  WHEN day < tfrom AND tp <> '51' THEN NULL WHEN tparent = h THEN NULL ELSE h = t OR coalesce(hparent = t, FALSE) END AS eligible FROM rows""")
def region_scope_places(spark, d):
    """People against the scope of each notice they order: a province's name, a district's code, its name, or both, or texts of several."""
    own = districts(spark, d)
    key = F.substring("code", 3, 3).cast("int") - 100
    home = own.select(key.alias("c_nationkey"), F.struct(F.col("province_code").alias("province"), F.col("code").alias("district"), F.col("parent_code").alias("parent"), "valid_from").alias("home"))
    target = own.select(key.alias("_t"), F.col("code").alias("t_code"), F.col("name").alias("t_name"), "province_code")
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(home), "c_nationkey")  # 25 nations
    rows = rows.join(F.broadcast(target), F.col("_t") == F.col("o_orderkey") % 25)
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, regions.province_name(F.col("province_code"))).when(k.isin(2, 3), F.concat(regions.province_name(F.col("province_code")), F.lit(" "), F.col("t_name"))).when(k == 4, F.col("t_name")).when(k == 5, "서울 또는 부산")
    rows = rows.withColumn("name", name).withColumn("code", F.when(k.isin(1, 3, 5), F.col("t_code")))
    rows = regions.by_name(regions.by_code(rows, "code", own, "coded"), "name", F.col("home.province"), own, "named")
    match = regions.matches_scope(F.col("home"), F.col("coded"), F.col("named"), F.col("code").isNotNull(), F.col("name").isNotNull(), F.col("o_orderdate").cast("date"))
    return rows.select(F.col("o_orderkey").alias("notice_id"), match.alias("eligible"))


@query("""SELECT c_custkey AS profile_id, count(s_suppkey) AS n_eligible FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN supplier ON s_nationkey = c_nationkey OR s_nationkey = n_regionkey GROUP BY 1""")
def region_scope_match(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scopes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    rows = scope_keys(people, F.col("c_nationkey"), F.col("n_regionkey")).join(scopes, "scope", "left")
    return rows.groupBy(F.col("c_custkey").alias("profile_id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_eligible"))


@query("""SELECT l_orderkey AS notice_id, l_linenumber AS pos, CASE WHEN l_suppkey % 7 = 0 THEN 'outside' WHEN l_suppkey % 7 = 1 THEN CASE WHEN l_linestatus = 'O' THEN 'missing_input' ELSE 'source_gap' END WHEN l_suppkey % 7 = 2 THEN 'source_gap'
  WHEN l_returnflag = 'R' THEN 'not_divided' WHEN l_linenumber = 7 THEN 'source_gap' WHEN l_linenumber = 6 THEN 'missing_input' WHEN l_linenumber = 5 THEN 'source_gap' WHEN l_linenumber < 3 THEN 'local'
  WHEN l_tax > 0.04 THEN 'other_gyeonggi' ELSE 'other' END AS decision FROM lineitem""")
def region_decisions(spark, d):
    k, n = F.col("l_suppkey") % 7, F.col("l_linenumber")
    admitted = F.when(k == 0, "fail").when(k == 1, "review").when(k > 2, "pass")
    local = F.when(n < 3, F.array(F.lit("pass"), F.lit("pass"))).when(n < 5, F.array(F.lit("pass"), F.lit("fail"))).when(n == 5, F.array(F.lit("review"), F.lit("fail"))).when(n == 6, F.array(F.lit("review"), F.lit("missing")))
    decision = regions.region_decision(admitted, F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "R", False), local, F.when(F.col("l_tax") > 0.04, True))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), n.alias("pos"), decision.alias("decision"))


@query("""WITH rows AS (SELECT *, l_suppkey % 8 AS k FROM lineitem)
SELECT l_orderkey AS notice_id, l_linenumber AS pos, CASE WHEN k = 0 THEN 'unknown' WHEN k = 1 THEN 'other' WHEN k = 2 THEN CASE WHEN l_returnflag = 'N' THEN 'local' WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'other_gyeonggi' END WHEN k = 3 THEN 'unknown'
  WHEN l_linenumber = 1 THEN 'unknown' WHEN l_linenumber = 2 THEN 'local' WHEN l_linenumber = 3 THEN 'unknown' WHEN k = 4 THEN CASE WHEN l_linestatus = 'O' THEN 'other_gyeonggi' ELSE 'other' END
  WHEN l_tax > 0.04 THEN 'other' WHEN l_linestatus = 'O' THEN 'other_gyeonggi' ELSE 'unknown' END AS area FROM rows""")
def residence_areas(spark, d):
    k, n = F.col("l_suppkey") % 8, F.col("l_linenumber")
    decision = F.when(k == 0, "outside").when(F.col("l_returnflag") == "N", "local").when(F.col("l_returnflag") == "A", "source_gap").otherwise("other_gyeonggi")
    arrays = lambda kind, *xs: F.array(*[F.lit(x).cast(kind) for x in xs])
    matches = F.when(n == 1, arrays("boolean", True, False)).when(n < 4, arrays("boolean", True, True)).otherwise(arrays("boolean", False))
    durations = F.when(n == 2, arrays("boolean", True, True)).when(n == 3, arrays("boolean", True, None)).otherwise(arrays("boolean", False))
    area = regions.residence_area(
        decision, F.when(k == 4, "pass").when(k == 3, "review"), F.when(k == 1, "other"), k == 2, F.when(F.col("l_linestatus") == "O", "41").otherwise("11"), F.lit(False), matches, arrays("string", "41", "41"), durations,
        F.col("l_linestatus") == "O", F.col("l_tax") > 0.04,
    )
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), n.alias("pos"), area.alias("area"))


@query("""WITH saved AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max_by(struct_pack(a := o_orderpriority, b := nullif(o_orderstatus, 'P')), o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN s IS NULL THEN c_name ELSE s.a END AS region, CASE WHEN s IS NULL THEN c_mktsegment ELSE s.b END AS district FROM orders JOIN customer ON c_custkey = orders.o_custkey
LEFT JOIN saved ON saved.o_custkey = orders.o_custkey AND saved.day = CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INTEGER)""")
def criterion_residence(spark, d):
    orders, day = table(spark, d, "orders"), F.col("o_orderdate").cast("date")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("region"), F.col("c_mktsegment").alias("district"))
    profiles = orders.join(people, "o_custkey").select("o_orderkey", F.col("o_custkey").alias("profile_id"), F.date_add(day, (F.col("o_orderkey") % 2).cast("int")).alias("day"), "region", "district")
    snapshots = orders.filter("o_orderstatus <> 'F'").select(
        F.col("o_custkey").alias("profile_id"), day.alias("criterion_date"), F.col("o_orderpriority").alias("region"), F.nullif("o_orderstatus", F.lit("P")).alias("district"), F.col("o_orderkey").alias("saved_at")
    )
    return regions.at_criterion(profiles, snapshots, "day", ["region", "district"]).select("o_orderkey", "region", "district")


MOVES = ("l_orderkey AS notice_id", "l_linenumber AS pos", "CASE WHEN l_suppkey % 9 > 0 THEN DATE '1996-06-01' END AS day", "l_returnflag <> 'N' AS inner_scope", "l_linestatus = 'O' AS province_match",
         "CASE l_linenumber WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END AS parent_match", "CAST(l_shipdate AS DATE) AS moved", "CASE WHEN l_suppkey % 2 = 0 THEN DATE '1995-01-01' END AS moved_city", "CASE WHEN l_suppkey % 3 = 0 THEN DATE '1997-01-01' WHEN l_suppkey % 3 = 1 THEN DATE '1994-01-01' END AS moved_district")


@query(f"""WITH rows AS (SELECT {', '.join(MOVES)} FROM lineitem), steps AS (
  SELECT *, coalesce(inner_scope AND NOT province_match AND moved <= day, FALSE) AS gone FROM rows), more AS (
  SELECT *, coalesce(inner_scope AND NOT gone AND NOT parent_match AND moved_city <= day, FALSE) AS gone_city, CASE WHEN NOT inner_scope THEN moved WHEN coalesce(parent_match, FALSE) THEN moved_city ELSE moved_district END AS own FROM steps)
SELECT notice_id, pos, CASE WHEN day IS NULL THEN 'no_date' WHEN moved > day OR (inner_scope AND NOT gone AND parent_match IS NOT NULL AND coalesce(moved_city > day, FALSE)) OR (inner_scope AND NOT gone AND NOT gone_city AND coalesce(own > day, FALSE)) THEN 'changed'
  WHEN gone OR gone_city OR own IS NOT NULL THEN NULL WHEN NOT inner_scope THEN 'moved' WHEN coalesce(parent_match, FALSE) THEN 'moved_city' ELSE 'moved_district' END AS review FROM more""")
def residence_reviews(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(*MOVES)
    return rows.select("notice_id", "pos", regions.residence_review(*(F.col(c) for c in ("day", "inner_scope", "province_match", "parent_match", "moved", "moved_city", "moved_district"))).alias("review"))


BASES = ("l_orderkey AS notice_id", "l_linenumber AS pos", "CASE l_linenumber WHEN 1 THEN 'application_date' WHEN 2 THEN 'contract_date' WHEN 3 THEN 'original_announcement' WHEN 4 THEN 'move_in' WHEN 5 THEN 'announcement' END AS basis",
         "CASE WHEN l_suppkey % 5 = 0 THEN '1998-02-03' WHEN l_suppkey % 5 = 1 THEN '1998-02-30' END AS specified", "CASE WHEN l_partkey % 2 = 0 THEN DATE '1998-05-05' END AS contract", "CASE WHEN l_partkey % 3 = 0 THEN DATE '1997-01-01' END AS original",
         "CASE l_returnflag WHEN 'A' THEN 'apt_ranked' WHEN 'N' THEN 'unranked_after' END AS method", "CASE WHEN l_linestatus = 'O' THEN DATE '1998-03-03' END AS method_day", "CAST(l_shipdate AS DATE) AS announced")


@query(f"""WITH rows AS (SELECT {', '.join(BASES)} FROM lineitem)
SELECT notice_id, pos, CASE WHEN basis = 'application_date' THEN DATE '1999-09-09' WHEN specified IS NOT NULL THEN TRY_CAST(specified AS DATE) WHEN basis = 'contract_date' THEN contract WHEN basis = 'original_announcement' THEN original WHEN basis = 'move_in' THEN NULL
  WHEN method = 'unranked_after' THEN coalesce(method_day, announced) ELSE coalesce(original, announced) END AS day FROM rows""")
def criterion_days(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(*BASES)
    day = dates.criterion_day(*(F.col(c) for c in ("basis", "specified", "contract", "original", "method", "method_day", "announced")), F.lit(date(1999, 9, 9)))
    return rows.select("notice_id", "pos", day.alias("day"))


@query("""WITH rows AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CAST(day + INTERVAL 19 YEAR AS DATE) AS adult, CAST(day - INTERVAL 89 DAY AS DATE) AS first_day,
  CASE k WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN DATE '2024-02-29' END AS token, CASE k WHEN 0 THEN CAST(DATE '2024-01-05' + INTERVAL 4 DAY AS DATE) WHEN 1 THEN day WHEN 3 THEN DATE '2024-12-31' END AS finish,
  CASE k WHEN 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR WHEN 1 THEN CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR - INTERVAL 9 HOUR WHEN 2 THEN CAST(day AS TIMESTAMP) - INTERVAL 9 HOUR WHEN 3 THEN CAST(day AS TIMESTAMP) - INTERVAL 5 HOUR END AS instant,
  CASE WHEN o_orderkey % 24 >= 15 THEN CAST(day + INTERVAL 1 DAY AS DATE) ELSE day END AS kst_day, CAST(86400 - ((o_orderkey + 9) % 24) * 3600 - o_orderkey % 60 AS BIGINT) AS seconds_left FROM rows""")
def day_functions(spark, d):
    """Birthdays, rolling ranges, dates of contracts, instants and days in Seoul."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    text = day.cast("string")
    token = F.when(k == 0, F.replace(text, F.lit("-"), F.lit(". "))).when(k == 1, F.concat(F.lit("계약일 "), text, F.lit(" (금)"))).when(k == 2, "24년 2월 29일").when(k == 3, "2024.02.30").otherwise("2024.01")
    finish = F.when(k == 0, "01.09").when(k == 1, text).when(k == 2, "02.30").when(k == 3, "12월 31일").otherwise("x")
    stamp = F.when(k == 0, F.concat(text, F.lit("T01:00:00Z"))).when(k == 1, F.concat(text, F.lit("T01:00:00"))).when(k == 2, text).when(k == 3, F.concat(text, F.lit("T02:00:00+07:00"))).otherwise("soon")
    at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600 + F.col("o_orderkey") % 60)
    there = dates.seoul_day(at)
    return table(spark, d, "orders").select(
        "o_orderkey", dates.birthday(day, 19).alias("adult"), dates.rolling_range(day)["first"].alias("first_day"), dates.date_token(token).alias("token"), dates.end_token(finish, F.lit(date(2024, 1, 5))).alias("finish"),
        dates.seoul_timestamp(stamp).cast("timestamp_ntz").alias("instant"), there["day"].alias("kst_day"), there["seconds_left"].alias("seconds_left"),
    )
