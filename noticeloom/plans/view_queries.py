"""Screens of notices: receptions, lists, targets, availability, counts. Orders are notices, lines their events and results."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.operators import availability as av
from noticeloom.operators import listing as ls
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table

TODAY = date(1997, 6, 1)
EVENTS = (
    "l_orderkey AS notice_id", "l_linenumber AS pos", "CASE l_linenumber % 5 WHEN 0 THEN 'Contract' WHEN 1 THEN 'first_priority' WHEN 2 THEN 'special' WHEN 3 THEN 'general' ELSE 'reception' END AS kind",
    "CASE WHEN l_linenumber % 5 = 4 AND l_quantity < 10 THEN '계약일' WHEN l_quantity < 20 THEN '상시 접수' WHEN l_linenumber % 5 = 2 THEN '신혼부부 특별공급' ELSE '접수' END AS label",
    "CAST(l_shipdate AS DATE) AS start_date", "CASE WHEN l_returnflag <> 'N' THEN CAST(CAST(l_shipdate AS DATE) + INTERVAL 3 DAY AS DATE) END AS end_date",
    "CASE l_suppkey % 4 WHEN 0 THEN '해당지역' WHEN 1 THEN '기타지역' WHEN 2 THEN '기타경기' END AS audience",
)
EVENTS_SQL = f"""evs AS (SELECT {', '.join(EVENTS)} FROM lineitem), told AS (
  SELECT *, kind <> 'contract' AS application, lower(kind) <> 'contract' AND label <> '계약일' AS reception,
    CASE WHEN end_date IS NULL AND lower(kind) <> 'contract' AND label = '상시 접수' THEN NULL ELSE coalesce(end_date, start_date) END AS last_day, end_date IS NULL AND lower(kind) <> 'contract' AND label = '상시 접수' AS open_ended FROM evs)"""
NOTICES_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Public_Rental' WHEN 1 THEN 'apt' WHEN 2 THEN 'unsold' WHEN 3 THEN '공공임대' ELSE 'urban' END AS category, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS price_cap_status, CAST(o_orderdate AS DATE) AS announcement_date, o_orderpriority AS title, CASE WHEN o_custkey % 3 > 0 THEN 'u' END AS official_url FROM orders"


def events(spark, d):
    return table(spark, d, "lineitem").selectExpr(*EVENTS)


def notices(spark, d):
    """orders with their lines as an array of events."""
    listed = events(spark, d).groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "label", "start_date", "end_date", "audience"))).alias("events"))
    own = table(spark, d, "orders").selectExpr(*[x.strip() for x in _split(NOTICES_SQL.removeprefix("SELECT ").removesuffix(" FROM orders"))])
    none = F.from_json(F.lit("[]"), listed.schema["events"].dataType)
    return own.join(listed, own["id"] == listed["notice_id"], "left").withColumn("events", F.coalesce("events", none)).drop("notice_id")


def _split(text: str) -> list[str]:
    return text.split(", ")


@query(f"""WITH {EVENTS_SQL}
SELECT notice_id, pos, reception, last_day, reception AND start_date <= DATE '1997-06-30' AND coalesce(last_day >= DATE '1997-06-01', TRUE) AS overlaps FROM told""")
def reception_days(spark, d):
    e = F.struct("kind", "label", "start_date", "end_date")
    overlaps = ls.reception_overlaps(e, F.lit(TODAY), F.lit(date(1997, 6, 30)))
    return events(spark, d).select("notice_id", "pos", ls.is_reception(e).alias("reception"), ls.reception_end(e).alias("last_day"), overlaps.alias("overlaps"))


@query(f"""WITH {EVENTS_SQL}, n AS ({NOTICES_SQL}), facts AS (
  SELECT notice_id, bool_or(coalesce(end_date, start_date) >= DATE '1997-06-01') AS later, count(*) FILTER (WHERE reception AND start_date <= DATE '1997-06-01' AND coalesce(last_day >= DATE '1997-06-01', TRUE)) AS today,
    bool_and(coalesce(last_day < DATE '1997-06-01', FALSE)) FILTER (WHERE application) AS over, bool_or(start_date <= DATE '1997-06-01') FILTER (WHERE application) AS begun,
    bool_or(kind = 'first_priority' AND audience = '해당지역' AND start_date <= DATE '1997-06-01') AS local_begun,
    bool_or(application AND coalesce(end_date, start_date) >= DATE '1997-03-03' AND start_date <= DATE '1997-08-30') AS near FROM told GROUP BY 1)
SELECT id, coalesce(later, FALSE) OR announcement_date >= DATE '1997-04-17' AS active, coalesce(today, 0) AS n_today, id % 10 = 0 OR coalesce(over, FALSE) OR coalesce(CASE WHEN category = 'apt' THEN local_begun ELSE begun END, FALSE) AS results_due,
  coalesce(near, FALSE) AND announcement_date BETWEEN DATE '1996-12-03' AND DATE '1997-07-31' AS polled FROM n LEFT JOIN facts ON id = notice_id""")
def notice_gates(spark, d):
    """Which notices are active, have a reception today, may have results, and are polled for them."""
    rows, today = notices(spark, d), F.lit(TODAY)
    due = ls.results_due(F.col("events"), F.col("id") % 10 == 0, F.col("category") == "apt", today)
    again = ls.polled(rows, today).select("id", F.lit(True).alias("polled"))
    rows = rows.select("id", ls.is_active(F.col("events"), F.col("announcement_date"), today).alias("active"), F.size(ls.active_receptions(F.col("events"), today)).cast("long").alias("n_today"), due.alias("results_due"))
    return rows.join(again, "id", "left").fillna(False, ["polled"])


@query("""WITH n AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS announcement_date, o_orderstatus FROM orders), spans AS (
  SELECT l_orderkey AS notice_id, bool_or(l_linestatus = 'O' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1998-03-03' AND DATE '1998-08-30') AS near FROM lineitem GROUP BY 1)
SELECT id, announcement_date FROM n JOIN spans ON id = notice_id WHERE near AND announcement_date BETWEEN DATE '1997-12-03' AND DATE '1998-07-31'""")
def poll_window_filter(spark, d):
    kind = F.when(F.col("l_linestatus") == "O", "general").otherwise("contract")
    event = F.struct(kind.alias("kind"), F.col("l_shipdate").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(event).alias("events"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("announcement_date")).join(own, "id")
    return ls.polled(rows, F.lit(date(1998, 6, 1))).select("id", "announcement_date")


@query(f"""WITH {EVENTS_SQL}, n AS ({NOTICES_SQL})
SELECT id, category FROM n WHERE category IN ('apt', 'unsold', 'urban') AND price_cap_status = 'yes' AND EXISTS (
  SELECT 1 FROM told AS t WHERE t.notice_id = id AND reception AND start_date <= DATE '1997-06-30' AND coalesce(last_day >= DATE '1997-06-01', TRUE))
  AND EXISTS (SELECT 1 FROM told AS t WHERE t.notice_id = id AND start_date <= DATE '1997-06-10' AND coalesce(end_date, start_date) >= DATE '1997-06-10')""")
def shown_notices(spark, d):
    return ls.shown(notices(spark, d), F.lit(TODAY), F.lit(date(1997, 6, 30)), cap_only=True, day=F.lit(date(1997, 6, 10))).select("id", "category")


@query(f"""WITH {EVENTS_SQL}, n AS ({NOTICES_SQL})
SELECT id FROM n WHERE official_url IS NOT NULL AND category IN ('apt', 'unsold') AND EXISTS (SELECT 1 FROM told AS t WHERE t.notice_id = id AND application AND (open_ended OR coalesce(end_date, start_date) >= DATE '1997-06-01'))
ORDER BY announcement_date DESC, id LIMIT 100""")
def reprocess_targets(spark, d):
    return ls.reprocess_targets(notices(spark, d), TODAY, sales_only=True, active=True, limit=1000).select("id")


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), (o_custkey % 3 = 0) DESC, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, o_orderkey) AS position FROM orders QUALIFY position <= 50""")
def korean_order(spark, d):
    """The first fifty of a list by day, candidates first, titles as Korean sorts them: digits, Hangul, then Latin letters without regard to case."""
    from pyspark.sql import Window

    title = F.element_at(F.array(F.lit("1차"), F.lit("가람"), F.lit("나래"), F.lit("apt")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 3 == 0).alias("candidate"), title.alias("title"))
    top = ls.in_order(rows).limit(50)
    w = Window.orderBy("day", F.col("candidate").desc(), F.collate("title", "ko"), "id")
    return top.withColumn("position", F.row_number().over(w).cast("long")).select("id", "position")  # fifty rows


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS title, 1 AS v FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'new' END, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END FROM orders WHERE o_orderkey % 5 > 0)
SELECT coalesce(b.o_orderkey, a.id) AS id, CASE WHEN b.o_orderkey IS NULL THEN a.title ELSE b.column1 END AS title, b.o_orderkey IS NULL OR coalesce(a.title = b.column1 AND a.v = b.column2, FALSE) AS reused
FROM a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'new' END AS column1, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS column2 FROM orders WHERE o_orderkey % 5 > 0) AS b ON a.id = b.o_orderkey""".replace(""", b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'new' END, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END FROM orders WHERE o_orderkey % 5 > 0)""", ""))
def calendar_union(spark, d):
    """Two catalogues, the later one first served, and which of its rows say what the first did."""
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    first = orders.filter("o_orderstatus <> 'O'").select(k.alias("id"), F.col("o_orderpriority").alias("title"), F.lit(1).alias("v"))
    later = orders.filter(k % 5 > 0).select(k.alias("id"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("new").alias("title"), F.when(k % 2 == 0, 1).otherwise(2).alias("v"))
    return ls.unchanged(first, ls.latest_of(first, later)).select("id", "title", "reused")


@query("""WITH s AS (SELECT event_type AS source, max(ts) FILTER (WHERE value >= 50) AS last_success FROM events GROUP BY 1)
SELECT string_agg(source || '=' || coalesce(CAST(epoch_us(last_success) AS VARCHAR), ''), '|' ORDER BY source) AS signature FROM s""")
def success_signature(spark, d):
    states = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.unix_micros(F.max(F.when(F.col("value") >= 50, F.col("ts").cast("timestamp")))).alias("last_success"))
    return ls.success_signature(states)


@query("""WITH o AS (SELECT event_type AS source, CASE WHEN value < 40 THEN 'ok' WHEN value < 80 AND event_type <> 'click' THEN 'fallback' WHEN value < 120 THEN 'pending' ELSE 'failed' END AS outcome, CAST(event_id % 9 AS BIGINT) AS rows, event_id % 2 = 0 AS complete FROM events WHERE event_type <> 'view' OR value >= 120)
SELECT source, count(*) FILTER (WHERE outcome IN ('ok', 'fallback')) AS n, CAST(coalesce(sum(rows) FILTER (WHERE outcome IN ('ok', 'fallback')), 0) AS BIGINT) AS rows, count(*) FILTER (WHERE outcome = 'pending') AS pending, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  count(*) FILTER (WHERE outcome = 'fallback') AS fallback, count(*) FILTER (WHERE outcome IN ('ok', 'fallback') AND complete) AS complete, CASE WHEN source = 'view' THEN 'error' ELSE 'partial' END AS status FROM o GROUP BY source""")
def collection_counters(spark, d):
    v = F.col("value")
    outcome = F.when(v < 40, "ok").when((v < 80) & (F.col("event_type") != "click"), "fallback").when(v < 120, "pending").otherwise("failed")
    rows = table(spark, d, "events").filter("event_type <> 'view' OR value >= 120")
    return ls.counters(rows.select(F.col("event_type").alias("source"), outcome.alias("outcome"), (F.col("event_id") % 9).alias("rows"), (F.col("event_id") % 2 == 0).alias("complete")))


@query("""WITH days AS (SELECT o_orderkey AS id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY title, id) AS ids, dense_rank() OVER (ORDER BY day) AS position FROM days GROUP BY day""")
def daily_groups(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("date").alias("day"))
    return ls.by_day(rows).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


COMBOS = ("l_orderkey AS notice_id", "l_linenumber AS pos", "CASE l_linenumber % 3 WHEN 0 THEN '일반공급' WHEN 1 THEN '신혼부부 특별공급' ELSE '생애최초 특별공급' END AS supply_type", "CASE WHEN l_quantity < 35 THEN 'mismatch' WHEN l_quantity < 45 THEN 'review' ELSE 'possible' END AS status")


@query(f"""WITH {EVENTS_SQL}, combos AS (SELECT {', '.join(COMBOS)} FROM lineitem), facts AS (
  SELECT notice_id, bool_and(status = 'mismatch') AS every, bool_and(status = 'mismatch') FILTER (WHERE supply_type = '일반공급') AS general, bool_and(status = 'mismatch') FILTER (WHERE supply_type <> '일반공급') AS special,
    bool_and(status = 'mismatch') FILTER (WHERE supply_type LIKE '신혼%') AS newlywed FROM combos GROUP BY 1), known AS (
  SELECT t.*, f.*, CASE audience WHEN '기타경기' THEN 'other_gyeonggi' WHEN '기타지역' THEN 'other' WHEN '해당지역' THEN 'local' END AS area, kind IN ('first_priority', 'general') AS is_general, kind = 'special' OR label LIKE '%특별%' AS is_special, label LIKE '신혼%' AS named FROM told AS t JOIN facts AS f ON t.notice_id = f.notice_id)
SELECT notice_id, pos, coalesce(CASE WHEN area <> 'other' OR (is_general AND notice_id % 7 = 0) THEN TRUE WHEN is_general AND general THEN TRUE WHEN NOT is_general AND is_special AND named AND newlywed IS NOT NULL THEN CASE WHEN newlywed THEN TRUE ELSE notice_id % 5 = 0 END
  WHEN NOT is_general AND is_special AND notice_id % 2 = 0 AND special THEN TRUE WHEN NOT is_general AND is_special AND special IS NULL THEN FALSE WHEN is_special AND is_general AND general IS NULL THEN FALSE WHEN NOT is_general AND NOT is_special AND every THEN TRUE ELSE notice_id % 5 = 0 END, FALSE) AS unavailable FROM known""")
def event_availability(spark, d):
    combos = table(spark, d, "lineitem").selectExpr(*COMBOS).groupBy("notice_id").agg(F.collect_list(F.struct("supply_type", "status")).alias("combos"))
    rows, k = events(spark, d).join(combos, "notice_id"), F.col("notice_id")
    out = av.event_unavailable(F.struct("kind", "label", "audience"), F.lit("other"), k % 7 == 0, F.col("combos"), k % 2 == 0, F.when(k % 5 == 0, "mismatch").otherwise("review"))
    return rows.select("notice_id", "pos", out.alias("unavailable"))


@query("""SELECT l_orderkey AS notice_id, l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN l_partkey % 2 = 0 OR l_quantity < 25 WHEN 1 THEN l_quantity < 25 ELSE FALSE END AS unavailable FROM lineitem""")
def row_availability(spark, d):
    supply = F.element_at(F.array(F.lit(" 일반 공급 "), F.lit("신혼부부 특별공급"), F.lit("Special"), F.lit(None).cast("string")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    unit = F.concat(F.lit("0"), (F.col("l_partkey") % 2).cast("string"), F.lit(".a"))
    out = av.row_unavailable(unit, supply, F.array(F.lit("00 A")), F.when(F.col("l_quantity") < 25, "mismatch").otherwise("review"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("pos"), out.alias("unavailable"))


@query("""WITH j AS (SELECT l_orderkey AS notice_id, CASE WHEN l_linenumber > 5 THEN NULL ELSE CAST(l_partkey % 3 AS VARCHAR) END AS unit, l_quantity < 30 AS bad FROM lineitem), own AS (SELECT notice_id, unit, bool_and(bad) AS bad FROM j WHERE unit IS NOT NULL GROUP BY 1, 2), every AS (SELECT notice_id, bool_and(bad) AS bad FROM j WHERE unit IS NULL GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS profile_id, own.notice_id, unit, own.bad AND coalesce(every.bad, TRUE) AS unavailable FROM own LEFT JOIN every ON own.notice_id = every.notice_id""")
def unit_availability(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.lit(1).cast("long").alias("profile_id"), F.col("l_orderkey").alias("notice_id"), F.when(F.col("l_linenumber") <= 5, F.concat(F.lit("."), (F.col("l_partkey") % 3).cast("string"))).alias("unit_type"),
        F.when(F.col("l_quantity") < 30, "mismatch").otherwise("possible").alias("status"),
    )
    return av.units_unavailable(rows)


@query("""SELECT l_orderkey AS notice_id, l_linenumber AS pos, NOT (l_linestatus = 'O' AND l_returnflag = 'N' AND l_suppkey % 2 = 0 AND l_linenumber % 2 = 0) AS event_open, NOT (l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linenumber < 3)) AS valid FROM lineitem""")
def live_closures(spark, d):
    """Whether general events are still open under live results, and whether earlier results still hold."""
    units = F.array(F.lit("84A"), F.lit("59.b"))
    closed = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("84 a"), F.lit("59B"))).otherwise(F.array(F.lit("84A")))
    event = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "General").otherwise("special").alias("kind"), F.lit("접수").alias("label"), F.lit(None).cast("string").alias("audience"))
    is_open = av.event_open(event, F.when(F.col("l_linestatus") == "O", "other").otherwise("local"), F.lit("ok"), F.col("l_returnflag") == "N", units, units, closed)
    valid = av.historical_valid(F.when(F.col("l_returnflag") == "R", "pending").otherwise("ok"), F.when(F.col("l_returnflag") == "A", True), F.when(F.col("l_linenumber") < 3, "공고 변경 후 재확인").otherwise("접수 시작 전"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("pos"), is_open.alias("event_open"), valid.alias("valid"))


@query("""WITH r AS (SELECT l_orderkey AS notice_id, CAST(l_partkey % 2 AS VARCHAR) AS unit, l_linenumber <> 7 AS general FROM lineitem WHERE l_linestatus = 'O'), c AS (SELECT DISTINCT l_orderkey AS notice_id, CAST(l_partkey % 2 AS VARCHAR) AS unit FROM lineitem WHERE l_returnflag = 'A' OR l_orderkey % 3 = 0)
SELECT r.notice_id, coalesce(string_agg(DISTINCT r.unit, ',' ORDER BY r.unit) FILTER (WHERE general AND c.unit IS NOT NULL), '') AS closed_units, coalesce(bool_and(c.unit IS NOT NULL) FILTER (WHERE general), FALSE) AS all_general_closed,
  coalesce(bool_and(c.unit IS NOT NULL) FILTER (WHERE general), FALSE) AND bool_and(general) AND r.notice_id % 2 = 0 AS all_closed FROM r LEFT JOIN c ON r.notice_id = c.notice_id AND r.unit = c.unit GROUP BY r.notice_id""")
def historical_decisions(spark, d):
    lines, unit = table(spark, d, "lineitem"), (F.col("l_partkey") % 2).cast("string")
    results = lines.select(F.col("l_orderkey").alias("notice_id"), F.concat(unit, F.lit(".")).alias("unit_type"), F.when(F.col("l_linenumber") == 7, "기관추천").otherwise("일반공급").alias("supply_type"), F.when(F.col("l_linestatus") == "O", "official").otherwise("unknown").alias("verification"))
    closed = lines.filter("l_returnflag = 'A' OR l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("notice_id"), unit.alias("unit")).distinct()
    others = table(spark, d, "orders").select(F.col("o_orderkey").alias("notice_id"), (F.col("o_orderkey") % 2 == 1).alias("special"))
    return av.historical_decisions(results, closed, others).withColumn("closed_units", F.array_join("closed_units", ","))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS notice_id, CASE l_linenumber % 4 WHEN 0 THEN '일반공급' WHEN 1 THEN '신혼부부 특별공급' WHEN 2 THEN '생애 최초 특별공급' ELSE '장애인 특별공급' END AS supply_type FROM lineitem), r AS (
  SELECT l_orderkey AS notice_id, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN '신혼부부 특별공급' WHEN l_linenumber % 4 = 2 THEN '생애 최초 특별공급' ELSE '장애인 특별공급' END AS scope, CASE WHEN l_suppkey % 2 = 0 THEN 'marital_status' ELSE 'never_owned_home' END AS kind, CASE WHEN l_quantity < 5 THEN 'fail' WHEN l_quantity < 10 THEN 'review' ELSE 'pass' END AS result FROM lineitem), j AS (
  SELECT o.notice_id, o.supply_type, bool_or(result = 'fail') AS f, bool_or(result = 'review') AS w, bool_or(CASE WHEN supply_type LIKE '신혼%' THEN kind = 'marital_status' WHEN supply_type LIKE '생애%' THEN kind = 'never_owned_home' ELSE FALSE END) AS typical FROM o JOIN r ON o.notice_id = r.notice_id AND (scope IS NULL OR scope = supply_type) WHERE supply_type <> '일반공급' GROUP BY 1, 2)
SELECT CAST(7 AS BIGINT) AS profile_id, notice_id, supply_type, CASE WHEN supply_type LIKE '신혼%' THEN 'newlywed' WHEN supply_type LIKE '생애%' THEN 'first_home' ELSE 'other' END AS type,
  CASE WHEN f THEN 'mismatch' WHEN w THEN 'review' WHEN typical OR notice_id % 3 = 0 THEN 'possible' ELSE 'review' END AS status FROM j""")
def special_diagnoses(spark, d):
    names = F.array(F.lit("일반공급"), F.lit("신혼부부 특별공급"), F.lit("생애 최초 특별공급"), F.lit("장애인 특별공급"))
    lines, n = table(spark, d, "lineitem"), F.col("l_linenumber") % 4
    supply = F.element_at(names, (n + 1).cast("int"))
    offered = lines.select(F.col("l_orderkey").alias("notice_id"), supply.alias("supply_type"))
    q = F.col("l_quantity")
    results = lines.select(
        F.lit(7).cast("long").alias("profile_id"), F.col("l_orderkey").alias("notice_id"), F.when(n > 0, supply).alias("supply_type"), F.when(F.col("l_suppkey") % 2 == 0, "marital_status").otherwise("never_owned_home").alias("kind"),
        F.when(q < 5, "fail").when(q < 10, "review").otherwise("pass").alias("result"),
    )
    return av.special_diagnoses(offered, results, offered.filter("notice_id % 3 = 0"))


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS notice_id, CAST(l_partkey % 4 AS VARCHAR) AS unit FROM lineitem), r AS (SELECT notice_id, unit, CASE WHEN unit = '0' THEN 'first' WHEN notice_id % 2 = 0 THEN 'unknown' END AS rank FROM u)
SELECT CAST(3 AS BIGINT) AS profile_id, notice_id, rank, string_agg(unit, ',' ORDER BY unit) AS units FROM r GROUP BY 2, 3""")
def unit_rank_groups(spark, d):
    unit = (F.col("l_partkey") % 4).cast("string")
    prices = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), unit.alias("unit_type"))
    person = F.lit(3).cast("long").alias("profile_id")
    ranks = prices.filter("unit_type = '0'").select(person, "notice_id", "unit_type", F.lit("first").alias("rank"))
    ranks = ranks.unionByName(prices.select(person, "notice_id", F.lit(None).cast("string").alias("unit_type"), F.when(F.col("notice_id") % 2 == 0, "unknown").alias("rank")))
    return av.grouped_units(av.unit_ranks(prices, ranks), "rank").withColumn("units", F.array_join("units", ","))


@query("""WITH r AS (SELECT l_orderkey AS notice_id, l_linenumber * 1000000 + l_partkey AS pos, l_returnflag AS label, l_partkey AS extra, CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'source_gap' END AS category FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_linenumber = 2))
SELECT notice_id, label, min(pos) AS pos, max_by(extra, pos) AS extra FROM r GROUP BY 1, 2""")
def distinct_reasons(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("notice_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("extra"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2), "source_gap").alias("category"),
    )
    return av.distinct_reasons(av.actionable(rows), ["notice_id"], ["label"]).select("notice_id", "label", "pos", "extra")


@query("""SELECT o_orderkey AS notice_id, CASE WHEN o_orderstatus = 'F' THEN '내 조건으로 신청 불가' WHEN o_orderstatus = 'P' THEN '내 조건과 일치' WHEN o_custkey % 3 > 0 THEN '추가 입력 ' || (o_custkey % 3) || '개' WHEN o_orderkey % 4 > 0 THEN '확인한 ' || (o_orderkey % 4) || '개 조건 충족' ELSE '모집 정보' END AS label FROM orders""")
def compared_labels(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "mismatch").when(F.col("o_orderstatus") == "P", "possible").otherwise("review")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("notice_id"), av.compared_label(status, F.col("o_custkey") % 3, F.col("o_orderkey") % 4).alias("label"))


@query("""WITH r AS (SELECT l_orderkey AS notice_id, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT count(n) AS notices, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS unavailable_notices, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS unavailable_units FROM orders LEFT JOIN r ON o_orderkey = notice_id""")
def results_summary(spark, d):
    k = F.col("o_orderkey")
    decisions = table(spark, d, "orders").select(k.alias("notice_id"), F.when(k % 2 == 0, F.array(F.lit("84A"), F.lit("84.a"))).otherwise(F.array(F.lit("84A"), F.lit("59"))).alias("closed_units"), (k % 3 == 0).alias("all_closed"))
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.when(F.col("l_linestatus") == "O", "official").alias("verification"))
    return av.results_summary(decisions, results)


@query(f"""WITH {EVENTS_SQL}
SELECT notice_id, pos, reception AND coalesce(notice_id % 5 > 0, TRUE) AND CASE audience WHEN '기타경기' THEN FALSE WHEN '기타지역' THEN notice_id % 2 = 0 AND notice_id % 5 > 1 WHEN '해당지역' THEN notice_id % 2 = 0 AND notice_id % 7 > 0 ELSE (notice_id % 5 > 1 OR notice_id % 2 = 0) AND notice_id % 7 > 0 END AS candidate FROM told""")
def candidate_events(spark, d):
    """Events for a local resident (of even notices) by area, duration and admission; the region is named by no event."""
    k, event = F.col("notice_id"), F.struct("kind", "label", "audience", "start_date", "end_date")
    admitted = F.when(k % 5 == 0, "fail").when(k % 5 > 1, "pass")
    out = av.candidate_event(event, admitted, F.lit("local"), k % 2 == 0, F.when(k % 7 == 0, False), F.lit(True), F.lit(False), F.array(F.lit("부산")))
    return events(spark, d).select("notice_id", "pos", out.alias("candidate"))


@query(f"""WITH {EVENTS_SQL}
SELECT notice_id, bool_or(reception AND pos % 2 = 0 AND start_date <= DATE '1997-06-30' AND coalesce(last_day >= DATE '1997-06-01', TRUE)) AS present FROM told GROUP BY 1""")
def candidates_in_range(spark, d):
    rows = notices(spark, d).filter(F.size("events") > 0)
    flags = F.transform("events", lambda e: e["pos"] % 2 == 0)
    return rows.select(F.col("id").alias("notice_id"), av.candidate_in_range(F.col("events"), flags, F.lit(TODAY), F.lit(date(1997, 6, 30))).alias("present"))
