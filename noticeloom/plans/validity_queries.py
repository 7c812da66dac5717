"""Rules that hold, coverage, prices and areas; documents, bodies of services, profiles and labels."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions import labels
from noticeloom.functions.dates import contract_day
from noticeloom.operators import documents as docs
from noticeloom.operators import profiles, validity
from noticeloom.operators.dealing import dealt
from noticeloom.plans.region_queries import districts
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table
from noticeloom.sources import envelopes

# Lines as rules of documents: an `all` of one condition, some with an exception.
RULES = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS rule_id", "l_orderkey AS notice_id", "CASE WHEN l_suppkey % 3 > 0 THEN 'official_document_parser' ELSE 'feed' END AS source", "'v' || CAST(9 - l_linenumber % 4 AS STRING) AS version",
    "CASE WHEN l_partkey % 5 = 0 THEN 'other' ELSE 'h' END AS hash", "CASE WHEN l_partkey % 7 = 0 THEN 'v1' END AS child_version", "l_partkey % 11 = 0 AS bad_exception", "l_quantity",
)
RULES_SQL = f"base AS (SELECT DISTINCT {', '.join(RULES)} FROM lineitem)"
NOTICES = ("o_orderkey AS notice_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'unsold' ELSE 'apt' END AS category", "CASE WHEN o_orderkey % 9 = 0 THEN '무순위 모집' ELSE '모집' END AS title", "CASE WHEN o_orderkey % 3 > 0 THEN 'h' END AS document_hash")


def rule_rows(spark, d):
    """rule_id, notice_id, rule: JSON. Lines are dealt by notice before they are rules, so that neither texts nor trees are shuffled."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = dealt(lines, "l_orderkey").selectExpr(*RULES).distinct()
    child = F.struct(F.lit("age_min").alias("kind"), F.col("child_version").alias("parser_version"), F.when(F.col("l_quantity") % 2 == 0, "official").alias("verification"))
    bad = F.struct(F.lit("x").alias("kind"), F.lit(docs.PARSER).alias("source"), F.lit("v1").alias("parser_version"))
    rule = F.struct(
        F.when(F.col("l_quantity") % 3 == 0, "offered_supplies").otherwise("all").alias("kind"), F.col("source"), F.col("version").alias("parser_version"), F.col("hash").alias("document_hash"), F.lit("official").alias("verification"),
        F.when(F.col("l_quantity") % 5 > 0, F.array(child)).otherwise(F.filter(F.array(child), lambda _: F.lit(False))).alias("conditions"), F.when(F.col("bad_exception"), F.array(bad)).alias("exceptions"),
    )
    return rows.select("rule_id", "notice_id", F.to_json(rule).alias("rule"))


@query(f"""WITH {RULES_SQL}, n AS (SELECT {', '.join(NOTICES)} FROM orders), seen AS (
  SELECT notice_id, bool_or(source LIKE 'official%' AND version = 'v9') AS read FROM base GROUP BY 1), judged AS (
  SELECT b.*, source LIKE 'official%' AS parsed, n.document_hash IS NULL OR n.document_hash = hash AS hash_ok, seen.read, n.document_hash AS doc, category = 'unsold' OR title LIKE '무순위%' AS affected FROM base AS b JOIN n ON b.notice_id = n.notice_id JOIN seen ON seen.notice_id = b.notice_id)
SELECT rule_id FROM judged WHERE (NOT parsed OR (hash_ok AND (version = 'v9' OR (NOT read AND (version = 'v8' OR (version = 'v7' AND NOT affected))))))
  AND (NOT parsed OR child_version IS NULL OR l_quantity % 5 = 0) AND NOT bad_exception""")
def valid_rules(spark, d):
    return validity.valid_rules(rule_rows(spark, d), table(spark, d, "orders").selectExpr(*NOTICES), "v9", usable=("v8",), ordinary=("v7",))


@query(f"""WITH {RULES_SQL}, told AS (SELECT *, l_quantity % 3 > 0 AS requirement, l_quantity % 3 = 0 OR l_quantity % 5 > 0 AS filled, l_quantity % 5 = 0 OR l_quantity % 2 = 0 AS child_ok FROM base), own AS (SELECT notice_id, bool_and(filled AND child_ok) AS verified FROM told WHERE requirement GROUP BY 1)
SELECT o_orderkey AS notice_id, coalesce(verified, FALSE) AND CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 = 0 ELSE o_orderkey % 2 = 0 END AS complete FROM orders LEFT JOIN own ON o_orderkey = notice_id""")
def complete_notices(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 3
    verified = validity.with_verified(rule_rows(spark, d))
    topic = lambda required, status: F.struct(F.lit(required).alias("required"), F.lit(status).alias("status"))
    topics = F.when(c == 0, F.array(topic(True, "verified"), topic(False, "missing"))).when(c == 1, F.array(topic(None, "missing"))).otherwise(F.array(topic(True, "partial")))
    orders = table(spark, d, "orders")
    scopes = orders.filter(k % 4 == 0).select(k.alias("notice_id"), F.lit(True).alias("complete"), topics.alias("topics"))
    return validity.complete_notices(verified, scopes, orders.select(k.alias("notice_id"), (k % 2 == 0).alias("declared")))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS notice_id, CAST(l_linenumber % 2 AS VARCHAR) AS unit_type, l_returnflag AS supply_type FROM lineitem), s AS (
  SELECT l_orderkey AS notice_id, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_linenumber % 2 AS VARCHAR) END AS unit_type, CASE WHEN l_suppkey % 2 = 0 THEN l_returnflag END AS supply_type, l_quantity > 10 AS official, l_tax < 0.05 AS complete, 't' || (l_linenumber % 2) AS topic FROM lineitem WHERE l_linestatus = 'O')
SELECT c.notice_id, c.unit_type, c.supply_type, coalesce(bool_and(official AND complete), FALSE) AS complete, count(*) FILTER (WHERE official) AS verified_count, coalesce(string_agg(DISTINCT topic, ',' ORDER BY topic), '') AS missing_topics
FROM c LEFT JOIN s ON s.notice_id = c.notice_id AND (s.unit_type IS NULL OR s.unit_type = c.unit_type) AND (s.supply_type IS NULL OR s.supply_type = c.supply_type) GROUP BY 1, 2, 3""")
def scope_coverage(spark, d):
    lines, unit = table(spark, d, "lineitem"), (F.col("l_linenumber") % 2).cast("string")
    combos = lines.select(F.col("l_orderkey").alias("notice_id"), unit.alias("unit_type"), F.col("l_returnflag").alias("supply_type")).distinct()
    scopes = lines.filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("notice_id"), F.when(F.col("l_linenumber") % 3 > 0, unit).alias("unit_type"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")).alias("supply_type"), (F.col("l_quantity") > 10).alias("official"),
        (F.col("l_tax") < 0.05).alias("complete"), F.array(F.concat(F.lit("t"), unit)).alias("missing_topics"),
    )
    own = scopes.select("notice_id", "unit_type", "supply_type", F.when(F.col("official"), "official").otherwise("x").alias("verification"))
    return validity.scope_coverage(combos, scopes.repartition(4), own).withColumn("missing_topics", F.array_join("missing_topics", ","))


@query("""WITH t AS (SELECT l_orderkey AS notice_id, CASE WHEN l_suppkey % 3 = 0 THEN 'a' || l_returnflag ELSE 'm' END AS topic, nullif(concat_ws(' · ', CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus END), '') AS scope,
  l_linenumber * 1000000 + l_partkey AS pos, CASE WHEN l_suppkey % 3 = 0 THEN 'r' || l_partkey END AS reason FROM lineitem WHERE l_suppkey % 3 < 2)
SELECT notice_id, topic, coalesce(string_agg(DISTINCT scope, ',' ORDER BY scope), '') AS scopes, min_by(reason, pos) AS reason FROM t GROUP BY 1, 2""")
def open_topics(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_suppkey") % 3
    open_ = F.struct(F.concat(F.lit("a"), F.col("l_returnflag")).alias("topic"), F.lit(None).cast("boolean").alias("required"), F.lit("missing").alias("status"), F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("reason"))
    done = F.struct(F.lit("z").alias("topic"), F.lit(True).alias("required"), F.lit("verified").alias("status"), F.lit(None).cast("string").alias("reason"))
    scopes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("notice_id"), (n * 1000000 + F.col("l_partkey")).alias("pos"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("supply_type"), F.when(n % 3 == 0, F.col("l_linestatus")).alias("unit_type"),
        F.when(k == 0, F.array(done, open_)).otherwise(F.array(done)).alias("topics"), F.when(k == 1, F.array(F.lit("m"), F.lit(" "))).when(k == 0, F.array(F.lit("never"))).alias("missing_topics"),
    )
    return validity.open_topics(scopes).withColumn("scopes", F.array_join("scopes", ","))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS notice_id, l_linenumber % 4 AS content, CASE l_linenumber % 4 WHEN 0 THEN 'metadata' END AS effect, CASE l_linenumber % 4 WHEN 1 THEN 'N' WHEN 2 THEN NULL ELSE 'A' END AS supply FROM lineitem), o AS (SELECT DISTINCT l_orderkey AS notice_id, l_returnflag AS supply_type FROM lineitem)
SELECT o.notice_id, supply_type, count(content) AS n_rules, count(*) FILTER (WHERE content = 2 AND o.notice_id % 2 = 0) AS n_partial, count(content) > 0 AND count(*) FILTER (WHERE content = 2 AND o.notice_id % 2 = 0) = 0 AS complete
FROM o LEFT JOIN r ON r.notice_id = o.notice_id AND effect IS NULL AND (supply IS NULL OR supply = supply_type) GROUP BY 1, 2""")
def document_coverage(spark, d):
    n, k = F.col("l_linenumber") % 4, F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(
        k.alias("notice_id"), F.col("l_linenumber").alias("pos"), F.when(n == 0, "metadata").alias("effect"), F.lit(None).cast("string").alias("purpose"), F.when(n == 1, "N").when(n == 3, "A").alias("supply_type"),
        n.cast("string").alias("content"), ((n == 2) & (k % 2 == 0)).alias("unparsed"),
    )
    return validity.document_rules(rows, table(spark, d, "lineitem").select(k.alias("notice_id"), F.col("l_returnflag").alias("supply_type")))[1]


@query("""SELECT l_orderkey AS notice_id, l_linenumber AS pos, CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 'housing' WHEN l_linenumber < 4 AND l_suppkey % 5 = 0 THEN 'day' WHEN l_linenumber < 4 AND CAST(l_shipdate AS DATE) < DATE '1995-01-01' THEN 'period' WHEN l_linenumber < 3 AND CAST(l_shipdate AS DATE) > DATE '1997-01-01' THEN 'period'
  WHEN l_linenumber = 7 THEN 'public_housing' END AS problem FROM lineitem""")
def scope_problems(spark, d):
    n = F.col("l_linenumber")
    out = validity.scope_problem(
        F.when(F.col("l_returnflag") == "A", "F"), F.col("l_linestatus"), F.when(n < 4, F.lit(date(1995, 1, 1))), F.when(n < 3, F.lit(date(1997, 1, 1))), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_shipdate").cast("date")),
        F.when(n == 7, True), F.lit(None).cast("boolean"),
    )
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), n.alias("pos"), out.alias("problem"))


@query("""SELECT notice_id, best FROM (SELECT l_orderkey AS notice_id, l_linenumber * 1000000 + l_partkey AS best, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_returnflag <> 'N' AS INTEGER) + CAST(l_linestatus = 'O' AS INTEGER) DESC, l_linenumber * 1000000 + l_partkey) AS r FROM lineitem) AS x WHERE r = 1""")
def most_specific_scope(spark, d):
    pos = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), pos.alias("pos"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("supply_type"), F.when(F.col("l_linestatus") == "O", "84A").alias("unit_type"))
    return validity.most_specific(rows, ["notice_id"]).select("notice_id", F.col("pos").alias("best"))


@query("""WITH p AS (SELECT l_orderkey AS notice_id, l_linenumber AS pos, CAST(l_partkey % 5 AS VARCHAR) AS unit, CASE WHEN l_linenumber < 5 THEN CAST(l_partkey % 5 AS DOUBLE) END AS area FROM lineitem), a AS (
  SELECT l_orderkey AS notice_id, CAST(l_partkey % 5 AS VARCHAR) AS unit, min(l_partkey % 5 + CAST(l_linenumber > 5 AS INTEGER)) AS low, max(l_partkey % 5 + CAST(l_linenumber > 5 AS INTEGER)) AS high FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT p.notice_id, pos, p.unit AS unit_type, CASE WHEN low = high THEN CAST(low AS DOUBLE) END AS exclusive, CASE WHEN low = high THEN CASE WHEN area = low THEN 'exclusive' WHEN area IS NOT NULL THEN 'supply' END END AS area_basis, CASE WHEN low = high AND low > 0 THEN CAST(low AS DOUBLE) END AS usable
FROM p LEFT JOIN a ON p.notice_id = a.notice_id AND p.unit = a.unit""")
def exclusive_areas(spark, d):
    unit, n = (F.col("l_partkey") % 5), F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), n.alias("pos"), unit.cast("string").alias("unit_type"), F.when(n < 5, unit.cast("double")).alias("area_sqm"), "l_returnflag", (unit + (n > 5).cast("int")).cast("double").alias("exclusive_area_sqm"))
    out = validity.exclusive_areas(lines.select("notice_id", "pos", "unit_type", "area_sqm"), lines.filter("l_returnflag <> 'N'"))
    return out.select("notice_id", "pos", "unit_type", F.col("exclusive_area_sqm").alias("exclusive"), "area_basis", validity.usable_area(F.col("exclusive_area_sqm"), F.lit(None).cast("string"), F.col("area_sqm")).alias("usable"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS n, l_returnflag AS s, l_partkey % 3 AS u FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT l_orderkey AS n, l_returnflag AS s, l_partkey % 3 AS u, max(l_linenumber) AS c FROM lineitem WHERE l_tax < 0.06 GROUP BY 1, 2, 3)
SELECT d.n AS notice_id, count(*) AS n_pairs, bool_or(c <> 3) AS conflict FROM d JOIN f ON d.n = f.n AND d.s = f.s AND d.u = f.u GROUP BY 1""")
def inventory_conflicts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("supply_type"), (F.col("l_partkey") % 3).cast("string").alias("unit_type"), "l_linenumber", "l_linestatus", "l_tax")
    document = rows.filter("l_linestatus = 'O'").select("notice_id", "supply_type", "unit_type", F.lit(3).alias("supply_count")).distinct()
    feed = rows.filter("l_tax < 0.06").groupBy("notice_id", "supply_type", "unit_type").agg(F.max("l_linenumber").alias("supply_count"))
    return validity.inventory_conflicts(document, feed)


@query("""WITH o AS (SELECT l_orderkey AS n, CAST(l_partkey % 4 AS VARCHAR) AS u, l_returnflag AS k, max(CASE WHEN l_quantity > 20 THEN CAST(l_partkey AS BIGINT) END) AS amount FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3),
c AS (SELECT l_orderkey AS n, CAST(l_partkey % 4 AS VARCHAR) AS u, l_returnflag AS k, max(CAST(l_suppkey AS BIGINT)) AS amount FROM lineitem WHERE l_tax > 0.03 GROUP BY 1, 2, 3)
SELECT coalesce(o.n, c.n) AS notice_id, coalesce(o.u, c.u) AS unit_type, coalesce(o.k, c.k) AS price_kind, coalesce(o.amount, c.amount) AS amount_krw, CASE WHEN o.amount IS NOT NULL THEN 'official' WHEN c.amount IS NOT NULL THEN 'ai_unverified' ELSE 'unknown' END AS verification
FROM o FULL JOIN c ON o.n = c.n AND o.u = c.u AND o.k = c.k""")
def merge_placeholders(spark, d):
    keys = [F.col("l_orderkey").alias("notice_id"), (F.col("l_partkey") % 4).cast("string").alias("unit_type"), F.col("l_returnflag").alias("price_kind")]
    lines = table(spark, d, "lineitem")
    official = lines.filter("l_linestatus = 'O'").select(*keys, F.when(F.col("l_quantity") > 20, F.col("l_partkey")).alias("amount_krw"))
    return validity.with_candidates(official, lines.filter("l_tax > 0.03").select(*keys, F.col("l_suppkey").alias("amount_krw")))


# Documents


@query("""SELECT o_orderkey AS notice_id, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) + 1 WHEN 1 THEN CAST(o_orderdate AS DATE) + 2 WHEN 2 THEN CAST(o_orderdate AS DATE) WHEN 3 THEN CAST(o_orderdate AS DATE) END AS day, CAST(CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 8 END AS INTEGER) AS page
FROM orders WHERE o_orderkey % 5 < 4 AND NOT (o_orderkey % 5 = 3 AND o_custkey % 2 = 0)""")
def document_cutoffs(spark, d):
    """Pages that state days of announcements: of special methods, of rounds, of the announcement; some only on page 9, some no day."""
    k, day = F.col("o_orderkey") % 5, F.date_add(F.col("o_orderdate").cast("date"), 10_227)  # 28 years
    said = lambda head, at, form: F.concat(F.lit(head), F.date_format(at, form))
    body = lambda page: (
        F.when((k == 0) & (page == 3), said("본 주택의  무순위(사후)\n입주자 모집공고일은 ", F.date_add(day, 1), "yyyy. M. d")).when((k == 0) & (page == 1), said("이 주택의 입주자모집공고일은 ", day, "yyyy-MM-dd"))
        .when((k == 1) & (page == 2), said("본 주택의 2회차 입주자모집공고일은 ", F.date_add(day, 2), "yyyy년 MM월 dd일")).when((k == 1) & (page == 1), said("이 주택의 최초 입주자모집공고일은 ", day, "yyyy.MM.dd"))
        .when((k == 2) & (page == 1), said("분양광고일 (", day, "yyyy/MM/dd")).when((k == 2) & (page == 4), "이 주택의 입주자모집공고일은 2024.02.30")
        .when((k == 3) & (page == F.when(F.col("o_custkey") % 2 == 0, 9).otherwise(8)), said("본 주택의 입주자모집공고일은", day, "yyyy.MM.dd")).otherwise("일정 2024.01.05")
    )
    orders = table(spark, d, "orders")
    pages = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("page")).select(F.col("o_orderkey").alias("notice_id"), "page", body(F.col("page")).alias("text"), F.when(k == 0, "unranked_after").when(k == 4, "optional_supply").alias("method"))
    out = docs.cutoffs(pages, "method", of=orders)
    return out.select("notice_id", F.date_sub("day", 10_227).alias("day"), "page")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '서울특별시,경기도' WHEN 1 THEN '' WHEN 2 THEN '서울특별시,인천광역시,경기도' WHEN 3 THEN '' WHEN 4 THEN '경기도' ELSE '' END AS scopes FROM part""")
def province_scopes(spark, d):
    texts = ("경기도 및 서울특별시에 거주하는 자".replace("경기도 및 서울특별시에 거주", "경기도 거주자와 서울특별시에 거주"), "경기도 성남시에 거주하는 자", "수도권(서울특별시·인천광역시·경기도)에 거주", "수도권(서울특별시·경기도 성남시)에 거주", "경기도에서 거주하는", "무주택 세대구성원")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(docs.province_scopes(text), ",").alias("scopes"))


@query("""SELECT notice_id, best FROM (SELECT l_orderkey AS notice_id, l_linenumber * 1000000 + l_partkey AS best, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 30 THEN 100 + l_quantity WHEN l_linestatus = 'O' THEN 10 ELSE 0 END DESC, l_linenumber * 1000000 + l_partkey) AS r FROM lineitem) AS x WHERE r = 1""")
def best_attachments(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_quantity") > 30, F.col("l_quantity")).otherwise(0).alias("n_conditions"), (F.col("l_linestatus") == "O").alias("readable"))
    return docs.best_attachment(rows).select("notice_id", F.col("pos").alias("best"))


@query("""WITH a AS (SELECT l_orderkey AS notice_id, l_linenumber AS pos, l_partkey % 6 AS k FROM lineitem)
SELECT notice_id, pos, 'download' AS stage, 'document_download_failed' AS code, 'error' AS status FROM a WHERE k = 0 UNION ALL SELECT notice_id, pos, 'read', CASE k WHEN 1 THEN 'document_decode_failed' WHEN 2 THEN 'document_no_text' ELSE 'document_read' END, CASE WHEN k < 3 THEN 'error' ELSE 'ok' END FROM a WHERE k > 0
UNION ALL SELECT notice_id, pos, 'interpretation', CASE k WHEN 3 THEN 'parser_failed' ELSE 'conditions_parsed' END, CASE k WHEN 3 THEN 'error' ELSE 'ok' END FROM a WHERE k IN (3, 4)""")
def document_stages(spark, d):
    k = F.col("l_partkey") % 6
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("pos"), (k > 0).alias("downloaded"), (k > 1).alias("decoded"), F.when(k == 2, 0).otherwise(9).alias("n_chars"), F.when(k == 4, 3).otherwise(0).alias("n_conditions"), (k == 3).alias("failed"))
    return docs.stages(rows).drop("message")


@query("""SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 4 = 0 THEN 'none' WHEN o_orderkey % 4 = 1 THEN 'stale' ELSE 'applied' END AS outcome, CASE WHEN o_orderkey % 4 = 2 THEN 'new' ELSE 'old' END AS document_hash,
  CASE WHEN o_orderkey % 4 < 2 THEN 'doc,ai,feed' WHEN o_orderkey % 4 = 2 THEN 'feed,read' WHEN o_custkey % 2 = 0 THEN 'ai,feed,read' ELSE 'doc,ai,feed,diag' END AS rules, CASE WHEN o_orderkey % 4 < 2 THEN 'a1,b2,c3' WHEN o_orderkey % 4 = 2 THEN 'b2,a9' ELSE 'b2,c3,a9' END AS prices FROM orders""".replace("'doc,ai,feed,diag' END AS rules", "'doc,ai,feed,diag' END AS rules"))
def document_patches(spark, d):
    """Readings applied to current rows: none, one of another notice state, one of a new document, one of the same (some diagnostics alone)."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 2
    rule = lambda source, verification, kind, content: F.struct(F.lit(source).alias("source"), F.lit(verification).alias("verification"), F.lit(kind).alias("kind"), F.lit(content).alias("content"))
    price = lambda unit, verification, n: F.struct(F.lit(unit).alias("unit_type"), F.lit(verification).alias("verification"), F.lit(n).alias("amount_krw"))
    orders = table(spark, d, "orders")
    current = orders.select(
        F.col("o_orderkey").alias("notice_id"), F.lit("old").alias("document_hash"), F.array(rule(docs.PARSER, "official", "x", "doc"), rule("model", "ai_unverified", "x", "ai"), rule("feed", "official", "x", "feed")).alias("rules"),
        F.array(price("a", "official", 1), price("b", "official", 2), price("c", "auto_unverified", 3)).alias("prices"),
    )
    parsed, diagnostics = rule(docs.PARSER, "official", "y", "read"), rule(docs.PARSER, "official", "document_diagnostics", "diag")
    read = orders.filter(k > 0).select(
        F.col("o_orderkey").alias("notice_id"), F.when(k == 2, "new").otherwise("old").alias("document_hash"), F.when((k == 3) & (c == 1), F.array(diagnostics)).otherwise(F.array(parsed, parsed)).alias("rules"),
        F.array(price("a", "official", 9), price("b", "ai_unverified", 8)).alias("prices"), (k == 1).alias("stale"),
    )
    out = docs.patched(current, read)
    prices = F.transform("prices", lambda p: F.concat(p["unit_type"], p["amount_krw"].cast("string")))
    return out.select("notice_id", "outcome", "document_hash", F.array_join(F.transform("rules", lambda r: r["content"]), ",").alias("rules"), F.array_join(prices, ",").alias("prices"))


@query("""WITH r AS (SELECT user_id, max_by(event_type, (ts, event_type)) AS status, max_by(event_id % 5 = 0, (ts, event_type)) AS stale, max(ts) AS seen FROM events WHERE user_id % 3 > 0 GROUP BY 1), s AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)
SELECT coalesce(r.user_id, s.user_id) AS external_id, CASE WHEN r.user_id IS NULL THEN DATE '2024-01-01' WHEN NOT stale THEN CAST(seen AS DATE) END AS audited_on, epoch_us(CASE WHEN r.user_id IS NULL OR stale THEN NULL WHEN status = 'click' THEN seen + INTERVAL 24 HOUR WHEN status = 'view' THEN seen + INTERVAL 3 HOUR END) AS deferred_until
FROM r FULL JOIN s ON r.user_id = s.user_id""")
def reading_states(spark, d):
    rows = table(spark, d, "events")
    key = [F.lit("lh").alias("source"), F.col("user_id").alias("external_id")]
    states = rows.filter("user_id % 2 = 0").select(*key, F.lit(date(2024, 1, 1)).alias("audited_on"), F.lit(None).cast("timestamp").alias("deferred_until")).distinct()
    kinds = {"click": "quota", "view": "deferred"}
    readings = rows.filter("user_id % 3 > 0").select(*key, F.col("event_type").alias("status"), (F.col("event_id") % 5 == 0).alias("stale"), F.col("ts").cast("timestamp").alias("at"))
    last = readings.groupBy("source", "external_id").agg(F.max_by(F.struct("status", "stale", "at"), F.struct("at", "status")).alias("r")).select("source", "external_id", "r.*")
    out = docs.reading_states(states, last.replace(kinds, subset=["status"]))
    return out.select("external_id", "audited_on", F.unix_micros("deferred_until").alias("deferred_until"))


@query("""SELECT user_id AS external_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 7 = 0 OR user_id % 4 = 0 OR user_id % 4 = 1 OR (user_id % 4 = 2 AND user_id % 5 = 0)""")
def due_readings(spark, d):
    k = F.col("external_id")
    notices = table(spark, d, "events").select(F.lit("lh").alias("source"), F.col("user_id").alias("external_id")).distinct().withColumn("changed", k % 7 == 0)
    now = F.lit("2024-03-01 10:00:00").cast("timestamp")
    states = notices.filter(k % 4 > 0).select(
        "source", "external_id", F.when(k % 4 == 1, F.lit(date(2024, 2, 28))).otherwise(F.lit(date(2024, 3, 1))).alias("audited_on"), F.when(k % 4 == 2, F.when(k % 5 == 0, now - F.expr("INTERVAL 1 HOUR")).otherwise(now + F.expr("INTERVAL 1 HOUR"))).alias("deferred_until"),
    )
    return docs.due_readings(notices, states, now).select("external_id")


@query("""SELECT l_orderkey AS notice_id, l_linenumber AS pos, CASE l_linenumber WHEN 1 THEN 'sale_max' WHEN 2 THEN 'deposit_monthly' WHEN 3 THEN 'deposit' WHEN 4 THEN 'deposit_monthly' END AS price_kind, CASE WHEN l_linenumber < 4 THEN l_partkey END AS amount_krw, CASE WHEN l_linenumber IN (2, 4) THEN l_suppkey END AS monthly_krw
FROM lineitem WHERE l_linenumber < 5 AND l_quantity > 10 AND l_returnflag <> 'N'""")
def cleaned_candidates(spark, d):
    n = F.col("l_linenumber")
    amount = F.when(F.col("l_returnflag") == "N", "-5").when((n < 4) | (n == 6), F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("notice_id"), n.alias("pos"), F.lit("84A").alias("unit_type"), F.when(n == 1, "SALE_MAX").when(n.isin(2, 3), "deposit").when(n == 4, "deposit_monthly").when(n == 5, "sale_total").otherwise("rent").alias("price_kind"),
        amount.alias("amount_krw"), F.when(n != 3, F.col("l_suppkey").cast("string")).alias("monthly_krw"), F.lit(None).cast("string").alias("basis_label"), F.when(F.col("l_quantity") > 10, "근거").otherwise(" ").alias("evidence_text"),
    )
    return docs.cleaned_candidates(rows).select("notice_id", "pos", "price_kind", "amount_krw", "monthly_krw")


# Bodies of services


@query("""SELECT o_orderkey AS page_id, CAST(CASE o_orderkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE 1 END AS INTEGER) AS n, CASE WHEN o_orderkey % 8 IN (0, 2) THEN CAST(o_custkey AS BIGINT) END AS total,
  CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3, 6, 7) THEN CAST(o_orderkey AS VARCHAR) END AS first_a FROM orders""")
def body_rows(spark, d):
    k = F.col("o_orderkey") % 8
    key = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit('{"a":'), key, F.lit("}"))
    shapes = (
        F.concat(F.lit('{"response":{"body":{"totalCount":"'), F.col("o_custkey").cast("string"), F.lit('","items":{"item":['), item, F.lit(',{"a":2},3]}}}}')), F.concat(F.lit('{"body":{"items":{"item":'), item, F.lit("}}}")),
        F.concat(F.lit('[{"CMN":{"TOTAL_CNT":"'), F.col("o_custkey").cast("string"), F.lit('"}},{"x":1},{"dsList":['), item, F.lit(",{}]}]")), F.concat(F.lit('{"data":['), item, F.lit("]}")),
        F.lit("not json"), F.lit('{"data":[]}'), F.concat(F.lit('{"item":'), item, F.lit("}")), F.concat(F.lit('{"posts":[1,'), item, F.lit("]}")),
    )
    body = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", envelopes.body_rows(body).alias("b"))
    return rows.select(F.col("o_orderkey").alias("page_id"), F.size("b.rows").alias("n"), F.col("b.total").alias("total"), F.get_json_object(F.try_element_at("b.rows", F.lit(1)), "$.a").alias("first_a"))


@query("""SELECT o_orderkey AS page_id, CASE o_orderkey % 8 WHEN 0 THEN '30' WHEN 1 THEN '22' WHEN 3 THEN '03' WHEN 7 THEN '99' END AS code, CASE o_orderkey % 8 WHEN 0 THEN 'key_unknown' WHEN 1 THEN 'quota' WHEN 3 THEN 'no_data' WHEN 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'service' END WHEN 5 THEN 'unknown' WHEN 6 THEN 'format' WHEN 7 THEN 'unknown' END AS cause,
  CASE WHEN o_orderkey % 8 = 2 OR (o_orderkey % 8 = 4 AND o_custkey % 2 = 1) THEN NULL ELSE o_custkey % 2 = 0 AND o_orderkey % 8 <> 6 END AS retryable FROM orders""")
def body_errors(spark, d):
    k = F.col("o_orderkey") % 8
    bodies = ('{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{"returnAuthMsg":"service_key_is_not_registered_error"}}}', '[{"CMN":{"CODE":"22"}}]', '{"response":{"header":{"resultCode":"00"}}}', '{"header":{"resultCode":"3"}}',
              '{"data":[]}', '{"error":{"code":"E-7"}}', "<html>", '{"error":{"code":99}}')
    body = F.element_at(F.array(*map(F.lit, bodies)), (k + 1).cast("int"))
    status = F.when((F.col("o_custkey") % 2 == 0) & (k != 6), 503).otherwise(F.when(k == 6, F.lit(None).cast("int")).otherwise(200))
    rows = table(spark, d, "orders").select("o_orderkey", envelopes.body_error(body, status).alias("e"))
    return rows.select(F.col("o_orderkey").alias("page_id"), "e.code", "e.cause", "e.retryable")


# Profiles and labels


@query("""WITH p AS (SELECT c_custkey, c_custkey % 6 AS v FROM customer)
SELECT c_custkey AS profile_id, CASE WHEN v = 0 THEN NULL ELSE '11' END AS region_code, CASE WHEN v = 0 THEN '' ELSE '2020-01-02' END AS moved, CASE WHEN v > 0 THEN CAST(c_custkey * 1000 AS BIGINT) END AS income, CASE WHEN v > 1 THEN TRUE END AS head, CASE WHEN v > 2 THEN FALSE END AS facts, CASE WHEN v > 3 THEN TRUE END AS complete,
  CASE WHEN v > 1 AND c_custkey % 4 > 0 THEN 'savings' ELSE 'unknown' END AS account, CASE WHEN v > 3 THEN 'korean' ELSE 'unknown' END AS citizenship FROM p""")
def migrated_profiles(spark, d):
    v, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    body = F.concat(
        F.lit('{"version":'), F.when(v == 1, "\"x\"").otherwise(v.cast("string")), F.lit(',"region":"서울","movedInDate":"2020-01-02","annualIncomeKrw":"'), F.regexp_replace(F.concat(key, F.lit("000")), r"(?<=\d)(?=(\d{3})+$)", ","),
        F.lit('","isHouseholdHead":true,"hasSpouse":"yes","ownershipFactsKnown":false,"householdMembersComplete":true,"citizenship":"korean","accountType":"'), F.when(F.col("c_custkey") % 4 > 0, "savings").otherwise("piggy"), F.lit('","odd":1}'),
    )
    out = profiles.migrated(table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.when(v > 0, body).otherwise("[").alias("body")), districts(spark, d))
    return out.select(
        "profile_id", "region_code", F.col("movedInDate").alias("moved"), F.col("annualIncomeKrw").alias("income"), F.col("isHouseholdHead").alias("head"), F.col("ownershipFactsKnown").alias("facts"),
        F.col("householdMembersComplete").alias("complete"), F.col("accountType").alias("account"), "citizenship",
    )


@query("""WITH p AS (SELECT c_custkey AS profile_id, c_custkey % 4 AS k FROM customer)
SELECT profile_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'income' WHEN 2 THEN 'household,marital' ELSE 'assets,pregnancy' END AS changed_groups, CASE k WHEN 1 THEN 'income:2024-01-01:7' WHEN 2 THEN 'household:2023-01-01:single' ELSE '' END AS snapshots,
  CASE k WHEN 0 THEN 'household=2023-01-01,income=2024-01-01' WHEN 1 THEN 'household=2023-01-01,income=2025-05-05' WHEN 2 THEN 'household=2025-05-05,income=2024-01-01,marital=2025-05-05' ELSE 'assets=2025-05-05,household=2023-01-01,income=2024-01-01,pregnancy=2025-05-05' END AS as_of FROM p""")
def edited_profiles(spark, d):
    k = F.col("profile_id") % 4
    fields = sorted({f for fs in profiles.GROUPS.values() for f in fs})
    known = {"annualIncomeKrw": "7", "maritalStatus": "single", "assetsKrw": "1"}
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"))
    as_of = F.create_map(F.lit("household"), F.lit(date(2023, 1, 1)), F.lit("income"), F.lit(date(2024, 1, 1)))
    rows = people.select("profile_id", as_of.alias("as_of"), *[F.lit(known.get(f)).cast("string").alias(f) for f in fields])
    change = lambda f, v: F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"))
    edits = F.when(k == 0, F.array(change("annualIncomeKrw", "7"))).when(k == 1, F.array(change("annualIncomeKrw", "8"), change("maritalStatus", "single"))).when(k == 2, F.array(change("maritalStatus", "married"))).otherwise(F.array(change("pregnant", "true"), change("assetsKrw", "2")))
    state, taken = profiles.edited(rows, people.select("profile_id", F.inline(edits)), F.lit(date(2025, 5, 5)))
    value = F.coalesce(F.col("values")["annualIncomeKrw"], F.col("values")["maritalStatus"])
    listed = taken.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "group", F.col("day").cast("string"), value))), ",").alias("snapshots"))
    entries = F.array_sort(F.transform(F.map_entries("as_of"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return state.join(listed, "profile_id", "left").select("profile_id", F.array_join("changed_groups", ",").alias("changed_groups"), F.coalesce("snapshots", F.lit("")).alias("snapshots"), F.array_join(entries, ",").alias("as_of"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '청약홈' WHEN 1 THEN 'example.org' WHEN 2 THEN 'LH' WHEN 3 THEN 'SH' ELSE 'elsewhere' END AS source, CASE o_orderkey % 6 WHEN 0 THEN 'rent' WHEN 1 THEN 'public' WHEN 2 THEN 'private' WHEN 3 THEN 'rent' WHEN 4 THEN 'private' ELSE 'other' END AS category,
  CASE o_orderkey % 4 WHEN 0 THEN '해당지역 1순위 마감' WHEN 1 THEN '접수 중' WHEN 2 THEN '종료' ELSE '마감 여부 미공개' END AS closing,
  CASE o_custkey % 7 WHEN 0 THEN '신청지역 제한 없음 · 접수일 후보' WHEN 1 THEN '기타경기 접수일 후보' WHEN 2 THEN '지역 우선순위 충족 후보' WHEN 3 THEN '지역 우선순위 미충족 · 접수일 확인' WHEN 4 THEN '지역 우선순위·접수일 확인 필요' WHEN 5 THEN '거주기간 충족 후보' ELSE '지역 일치 · 기간 확인 필요' END AS candidate FROM orders""")
def screen_labels(spark, d):
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (n + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 7
    source = labels.source_name(pick(k % 5, "x", "y", "z", "sh", "elsewhere"), pick(k % 5, "https://www.applyhome.co.kr/a", "http://www.example.org/", "https://apply.lh.or.kr", None, "ftp://lh.or.kr"))
    candidate = labels.candidate_label(c == 0, F.when(c == 1, "other_gyeonggi").otherwise("local"), c.isin(2, 3, 4), F.when(c == 2, True).when(c == 3, False), F.when(c == 5, True))
    return table(spark, d, "orders").select(
        "o_orderkey", source.alias("source"), labels.category_group(pick(k % 6, "Public_Rental", "public_sale", "APT", "행복주택", "민간 아파트", "기타")).alias("category"),
        labels.row_label(pick(k % 4, "local_first_closed", "open", "unknown", "unknown"), pick(k % 4, None, None, "종료", "")).alias("closing"), candidate.alias("candidate"),
    )


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 6 AS k, o_custkey % 2 = 0 AS even FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN NULL WHEN 1 THEN '공식 계약일을 확인하지 못해 계약일 기준 조건은 보류합니다.' WHEN 2 THEN '공식 계약일 ' || day || ' 기준으로 비교합니다.' || CASE WHEN day > DATE '1997-06-01' THEN ' 현재 입력이 유지될 때의 판정입니다.' ELSE '' END
  WHEN 3 THEN CASE WHEN day <= DATE '1997-06-01' THEN '공식 계약 일정 ' || day || '부터 ' || CASE WHEN even THEN '잔여세대 소진시까지' ELSE '종료일 미공개' END || ' · 오늘 계약한다면 (1997-06-01) 기준입니다.' ELSE '현재 진행 중인 공식 계약 일정이 없어 계약일 기준 조건은 보류합니다.' END
  ELSE CASE WHEN DATE '1997-06-01' < day THEN '공식 계약기간 ' || day || CASE WHEN k = 5 THEN ' – ' || CAST(day + INTERVAL 300 DAY AS DATE) ELSE '' END || ' · 시작일 ' || day || '에 현재 입력이 유지될 때의 판정입니다.' WHEN DATE '1997-06-01' <= CASE WHEN k = 5 THEN CAST(day + INTERVAL 300 DAY AS DATE) ELSE day END THEN '공식 계약기간 ' || day || CASE WHEN k = 5 THEN ' – ' || CAST(day + INTERVAL 300 DAY AS DATE) ELSE '' END || ' · 오늘 계약한다면 (1997-06-01) 기준입니다.'
    ELSE '공식 계약기간 ' || day || CASE WHEN k = 5 THEN ' – ' || CAST(day + INTERVAL 300 DAY AS DATE) ELSE '' END || ' 종료 · 실제 계약일이 없어 계약일 기준 조건은 보류합니다.' END END AS note,
  CASE k WHEN 2 THEN day WHEN 3 THEN CASE WHEN day <= DATE '1997-06-01' THEN DATE '1997-06-01' END WHEN 4 THEN CASE WHEN day >= DATE '1997-06-01' THEN day END WHEN 5 THEN CASE WHEN DATE '1997-06-01' < day THEN day WHEN DATE '1997-06-01' <= CAST(day + INTERVAL 300 DAY AS DATE) THEN DATE '1997-06-01' END END AS judged_on FROM r""")
def contract_notes(spark, d):
    day, k, today = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6, F.lit(date(1997, 6, 1))
    status = F.element_at(F.array(*map(F.lit, ("fixed", "unknown", "fixed", "ongoing", "range", "range"))), (k + 1).cast("int"))
    end = F.when(k.isin(2, 4), day).when(k == 5, F.date_add(day, 300))
    note = labels.contract_note(k > 0, status, F.lit(True), day, end, F.when(F.col("o_custkey") % 2 == 0, "계약은 잔여세대 소진시까지"), today)
    judged = F.when(k > 1, contract_day(status, day, end, F.lit("official"), today))
    return table(spark, d, "orders").select("o_orderkey", note.alias("note"), judged.alias("judged_on"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(70000 AS BIGINT) WHEN 1 THEN CAST(50000 AS BIGINT) END AS fee, CASE WHEN o_custkey % 2 = 0 THEN '기본 선정 순서: 지역 → 추첨. ' ELSE '' END AS selection,
  CASE WHEN o_custkey % 3 = 0 THEN '공식 지역별 배정 물량이 있습니다. ' ELSE '해당지역 30% · 기타 50%로 배정합니다. ' END || CASE WHEN o_orderkey % 2 = 0 THEN '경기도 배정에서는 해당지역을 먼저 선정합니다. ' ELSE '' END || CASE WHEN o_custkey % 2 = 0 THEN '기본 선정 순서: 지역 → 추첨. ' ELSE '' END || '배정 단계와 잔여물량 이동은 원문 기준입니다.' AS quota FROM orders""")
def fees_and_quotas(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    unit = lambda u, fee: F.struct(F.lit(u).alias("unit_type"), F.lit(fee).cast("long").alias("application_fee_krw"))
    rule = lambda verification, *units: F.struct(F.lit("supply_financial_terms").alias("kind"), F.lit(verification).alias("verification"), F.array(*units).alias("units"))
    rules_ = F.array(rule("unknown", unit("A", 1)), rule("official", unit("B", 50000), unit("b.", 60000)), rule("official", unit("C", -1)), rule("official", unit("A", 70000)))
    stages = F.when(c % 2 == 0, F.array(F.lit("지역"), F.lit(" "), F.lit("추첨"))).otherwise(F.array(F.lit("")))
    share = lambda area, percent, label: F.struct(F.lit(area).alias("residence_area"), F.lit(percent).alias("percent"), F.lit(label).cast("string").alias("label"))
    shares = F.when(c % 3 > 0, F.array(share("local", 30, None), share("other", 50, "기타"))).otherwise(F.filter(F.array(share("x", 1, None)), lambda _: F.lit(False)))
    order = labels.selection_order(stages, F.lit(True))
    wanted = F.element_at(F.array(F.lit("a"), F.lit(" B"), F.lit("C")), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", labels.application_fee(rules_, wanted).alias("fee"), order.alias("selection"), labels.quota_detail(shares, k % 2 == 0, F.lit(False), order).alias("quota"))
