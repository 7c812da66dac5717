"""Operators of the store, of merged notices, of results, applicants and documents, each over whole driver tables."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions import dates, text
from noticeloom.operators import clauses, competition, evaluation, history, merged, people, rules, store, tables
from noticeloom.operators.dealing import dealt
from noticeloom.operators.entities import current, exact_references
from noticeloom.plans.registry import query
from noticeloom.plans.tables import NOTICES_SQL, notices, table


def lines(spark, d):
    return table(spark, d, "lineitem")


@query(f"""WITH {NOTICES_SQL}, refs AS (SELECT source, id - 7 AS ref FROM notices WHERE category = '5-LOW' AND id >= 7)
SELECT id, source FROM notices AS n
WHERE NOT EXISTS (SELECT 1 FROM refs AS r WHERE r.source = n.source AND r.ref = n.id)""")
def superseded_anti_join(spark, d):
    rows = notices(spark, d).select(
        "id", "source", F.col("id").cast("string").alias("external_id"), F.lit(None).cast("long").alias("duplicate_of_id"), F.lit(None).cast("long").alias("correction_of_id"),
        F.when((F.col("category") == "5-LOW") & (F.col("id") >= 7), (F.col("id") - 7).cast("string")).alias("correction_of_external_id"),
    )
    return current(rows).select("id", "source")


@query("""WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS source, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey - o_orderkey % 4 AS VARCHAR) || 'g:' || (o_orderkey % 4) END AS ext,
  CASE WHEN o_orderkey % 10 = 3 THEN CAST(o_orderkey - 3 - (o_orderkey - 3) % 4 AS VARCHAR) WHEN o_orderkey % 10 = 7 THEN CAST(o_orderkey - o_orderkey % 4 AS VARCHAR) || 'g' END AS ref FROM orders),
pref AS (SELECT source, split_part(ext, ':', 1) AS p, min(id) AS id, count(*) AS c FROM n WHERE ext LIKE '%:%' GROUP BY 1, 2)
SELECT n.id, coalesce(e.id, CASE WHEN p.c = 1 AND p.id <> n.id THEN p.id END) AS original FROM n LEFT JOIN n AS e ON e.source = n.source AND e.ext = n.ref AND e.id <> n.id LEFT JOIN pref AS p ON p.source = n.source AND p.p = n.ref""")
def reference_resolution(spark, d):
    """References of corrections by an exact id of their source, else by the only id that begins with it; late ones are resolved alike."""
    k = F.col("o_orderkey")
    group = F.concat((k - k % 4).cast("string"), F.lit("g"))
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.col("o_orderstatus").alias("source"), F.when(k % 4 == 0, k.cast("string")).otherwise(F.concat(group, F.lit(":"), (k % 4).cast("string"))).alias("external_id"),
        F.when(k % 10 == 3, (k - 3 - (k - 3) % 4).cast("string")).when(k % 10 == 7, group).alias("correction_of_external_id"),
    )
    return exact_references(rows).select("id", F.col("correction_of_id").alias("original"))


# The store


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN 'external_id is missing' WHEN o_orderkey % 8 = 1 THEN 'title is missing' WHEN o_orderkey % 8 = 2 THEN 'price_cap_status is unknown' WHEN o_orderkey % 8 = 3 THEN 'a price kind is unknown' WHEN o_orderkey % 8 = 4 THEN 'money is negative' END AS error,
  CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE o_orderpriority END AS title, 1 AS n_events, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS end_date FROM orders""")
def checked_batch(spark, d):
    rows = payload(spark, d)
    good, bad = store.checked(rows)
    own = [F.col("_id").alias("id"), F.col("title"), F.size("events").alias("n_events"), F.try_element_at("events", F.lit(1))["end_date"].alias("end_date")]
    return good.select(F.lit(None).cast("string").alias("error"), *own).unionByName(bad.select("error", *own)).select("id", "error", "title", "n_events", "end_date")


def payload(spark, d):
    """Orders as rows of a batch: some lack an id or a title, some have an unknown status or kind, or money below zero."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    event = lambda start, end: F.struct(F.lit("general").alias("kind"), F.lit("x").alias("label"), start.alias("start_date"), end.alias("end_date"), F.lit(None).cast("string").alias("audience"))
    price = F.struct(
        F.lit("84A").alias("unit_type"), F.lit(84.0).alias("area_sqm"), F.when(k % 8 == 3, "gift").otherwise("sale").alias("price_kind"), F.when(k % 8 == 4, -1).otherwise(c).cast("long").alias("amount_krw"), F.lit(None).cast("long").alias("monthly_krw"),
        F.lit("official").alias("verification"), F.lit(None).cast("string").alias("document_hash"),
    )
    own = event(day, F.when(c % 2 == 0, day).otherwise(F.date_sub(day, 1)))
    none = lambda n, kind="string": F.lit(None).cast(kind).alias(n)
    return table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("source"), F.when(k % 8 > 0, k.cast("string")).alias("external_id"), none("provider"), F.when(k % 8 != 1, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise("  ").alias("title"),
        none("category"), F.lit("주소").alias("address"), none("region_code"), none("region_name"), day.alias("announcement_date"), F.lit("https://x.example").alias("official_url"), none("document_hash"),
        F.when(k % 8 == 2, "maybe").otherwise("unknown").alias("price_cap_status"), none("correction_of_external_id"), F.array(own, event(F.lit(None).cast("date"), day), own).alias("events"),
        F.when(c % 3 > 0, F.array(price)).when(k % 8 > 2, F.array(price)).otherwise(F.filter(F.array(price), lambda _: F.lit(False))).alias("prices"), k.alias("_id"),
    )


@query("""WITH n AS (SELECT o_orderkey AS k, o_custkey % 3 AS c, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT k AS row, CAST(k AS VARCHAR) AS external_id, CASE WHEN c = 0 AND k % 2 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN c = 2 THEN 1 ELSE 2 END AS last_seen, c = 0 AND k % 2 = 0 AND k % 4 = 2 AS proof_invalidated, day AS original_date, 'P' AS provider, NULL AS error FROM n WHERE k % 8 > 4
UNION ALL SELECT k, CASE WHEN k % 8 > 0 THEN CAST(k AS VARCHAR) END, NULL, NULL, NULL, NULL, NULL, CASE k % 8 WHEN 0 THEN 'external_id is missing' WHEN 1 THEN 'title is missing' WHEN 2 THEN 'price_cap_status is unknown' WHEN 3 THEN 'a price kind is unknown' ELSE 'money is negative' END FROM n WHERE k % 8 < 5""")
def store_versions(spark, d):
    """Two polls of all notices: the second leaves out a third of them, sends a third again as they were, and changes the even ones of a
    third. Rows that the check rejects are told with their error."""
    rows = payload(spark, d).withColumn("provider", F.lit("P"))
    k = F.col("_id")
    customers = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), (F.col("o_custkey") % 3).alias("_c"))
    rows = rows.join(customers, "_id")
    later = rows.filter("_c < 2").withColumn("provider", F.lit(None).cast("string"))  # unknown now: what was known stays
    changed = (F.col("_c") == 0) & (k % 2 == 0)
    later = later.withColumn("announcement_date", F.when(changed & (k % 4 == 2), F.date_add("announcement_date", 5)).otherwise(F.col("announcement_date")))
    later = later.withColumn("category", F.when(changed, "new"))
    at = lambda n: F.timestamp_seconds(F.lit(n))
    state, _ = store.upsert(None, store.checked(rows.drop("_id", "_c"))[0], at(1))
    state, _ = store.upsert(state, store.checked(later.drop("_id", "_c"))[0], at(2))
    kept = state.select(F.col("external_id").cast("long").alias("row"), "external_id", "version", F.unix_seconds("last_seen_at").cast("int").alias("last_seen"), "proof_invalidated", "original_date", "provider", F.lit(None).cast("string").alias("error"))
    bad = store.checked(rows)[1].select(k.alias("row"), "external_id", "error")
    return kept.unionByName(bad, allowMissingColumns=True)


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderstatus AS source, CAST(o_orderkey AS VARCHAR) AS ext, CAST(o_custkey AS VARCHAR) AS f, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || (o_orderkey % 20) END AS url FROM orders),
byf AS (SELECT f, min((k, source, ext)) AS m FROM n GROUP BY 1), byu AS (SELECT url, min((k, source, ext)) AS m FROM n WHERE url IS NOT NULL GROUP BY 1)
SELECT ext AS external_id, CASE WHEN byf.m[2] <> source THEN byf.m[3] WHEN byu.m[2] <> source THEN byu.m[3] ELSE ext END AS canonical FROM n JOIN byf ON n.f = byf.f LEFT JOIN byu ON n.url = byu.url""".replace("m[2]", "m.source").replace("m[3]", "m.ext").replace("min((k, source, ext))", "min(struct_pack(k := k, source := source, ext := ext))"))
def store_duplicates(spark, d):
    """Canonical notices by fingerprint, else by URL, the first seen whatever the order of arrival."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.timestamp_seconds(k).alias("first_seen_at"), F.col("o_orderstatus").alias("source"), k.cast("string").alias("external_id"), F.col("o_custkey").cast("string").alias("fingerprint"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), (k % 20).cast("string"))).alias("official_url"),
    )
    return store.duplicates(rows).select("external_id", F.col("canonical.external_id").alias("canonical"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE sha256(lower(replace(p_name, ' ', '')) || '동101' || '|2024-01-05') END AS fingerprint, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN NULL ELSE p_type END AS usable,
  CASE WHEN p_partkey % 3 = 0 THEN '제목' ELSE '[보도] 제목' END AS base, '{"a":' || p_size || ',"b":[1,2]}' AS canonical, CASE p_partkey % 3 WHEN 0 THEN '미공개' WHEN 1 THEN '미달 ' || p_size || '세대' ELSE p_size || '.50' END AS rate FROM part""".replace("|| '동101' ||", "|| '|동101' ||"))
def text_functions(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    blank = lambda n, c: F.when(k % 4 == n, F.concat(F.lit(" "), c, F.lit(" ")))
    usable = text.first_usable(F.coalesce(blank(0, F.col("p_name")), F.lit("null")), F.when(k % 4 == 1, F.col("p_brand")).otherwise(" - "), F.when(k % 4 == 3, F.col("p_type")))
    found = text.fingerprint(F.concat(F.col("p_name"), F.lit(" !")), F.when(k % 5 == 0, "…").otherwise("동 101"), F.lit(date(2024, 1, 5)))
    rate = F.when(k % 3 == 0, " - ").when(k % 3 == 1, F.concat(F.lit("(△"), size, F.lit(")"))).otherwise(F.concat(size, F.lit(".50")))
    return table(spark, d, "part").select(
        "p_partkey", found.alias("fingerprint"), usable.alias("usable"), text.base_title(F.when(k % 3 == 0, " [정정공고] 제목").otherwise("[보도] 제목")).alias("base"),
        text.canonical_json(F.concat(F.lit('{"b": [1, 2], "a": '), size, F.lit("}"))).alias("canonical"), text.rate_label(rate).alias("rate"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) END AS strict, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS lenient, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2024-02-29' END AS short, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_korean, DATE '2024-03-05' AS korean FROM orders""")
def lenient_dates(spark, d):
    k, iso = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date").cast("string")
    shown = F.when(k == 0, iso).when(k == 1, F.replace(iso, F.lit("-"), F.lit(""))).when(k == 2, F.concat(F.replace(iso, F.lit("-"), F.lit(".")), F.lit("T09:00"))).otherwise("2024-02-30")
    korean = F.when(F.col("o_orderkey") % 3 == 0, "2024년 3월 5일부터 2024년 03월 09일").otherwise("2024년3월 5일 2024년 13월 1일")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.strict_date(shown).alias("strict"), dates.lenient_date(shown).alias("lenient"), dates.short_year_date(F.when(k % 2 == 0, "24.2.29.").otherwise("24.2.30")).alias("short"),
        F.size(dates.korean_dates(korean)).alias("n_korean"), dates.korean_dates(korean)[0].alias("korean"),
    )


@query("""WITH l AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS former FROM events)
SELECT user_id, event_id, event_type FROM l WHERE former IS DISTINCT FROM event_type""")
def change_detection(spark, d):
    return store.snapshots(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id", "event_type")


@query("""WITH current AS (SELECT user_id, count(*) AS version FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.event_id, CASE WHEN e.event_id % 70 + 1 IS DISTINCT FROM c.version THEN 'stale' WHEN e.value < 20 THEN 'failed' ELSE 'accepted' END AS outcome, coalesce(e.event_id % 70 + 1 = c.version AND e.value >= 20 AND e.event_id % 2 = 0, FALSE) AS complete
FROM events AS e LEFT JOIN current AS c ON e.user_id = c.user_id WHERE e.event_type = 'purchase'""")
def stale_result_rejection(spark, d):
    rows = table(spark, d, "events")
    states = rows.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("notice_id")).agg(F.count(F.lit(1)).alias("version"))
    results = rows.filter("event_type = 'purchase'").select(
        "event_id", F.col("user_id").alias("notice_id"), (F.col("event_id") % 70 + 1).alias("expected_version"), F.when(F.col("value") >= 20, F.array(F.lit("x"))).alias("rows"), (F.col("event_id") % 2 == 0).alias("complete"),
    )
    return store.competition_result(states, results).select("event_id", "outcome", "complete")


@query("""WITH last AS (SELECT user_id, max(CAST(ts AS DATE)) AS won FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY user_id)
SELECT e.user_id, e.cutoff, l.won, CASE WHEN l.won IS NULL THEN TRUE ELSE NOT (e.cutoff <= CAST(l.won + INTERVAL 1 MONTH AS DATE)) END AS passes
FROM (SELECT user_id, CAST(max(CAST(ts AS DATE)) + INTERVAL 20 DAY AS DATE) AS cutoff FROM events GROUP BY user_id) AS e LEFT JOIN last AS l ON e.user_id = l.user_id""")
def history_window_restriction(spark, d):
    day = F.col("ts").cast("date")
    rows = table(spark, d, "events")
    people_ = rows.groupBy("user_id").agg(F.date_add(F.max(day), 20).alias("cutoff"))
    won = rows.filter("event_type = 'purchase' AND value > 100").select("user_id", day.alias("day"))
    return history.restricted(people_, won, ["user_id"], "cutoff", "day", 1).select("user_id", "cutoff", F.col("last").alias("won"), "passes")


@query("""SELECT l_orderkey AS profile_id, CAST(count(*) FILTER (WHERE CAST(l_shipdate AS DATE) + INTERVAL 36 MONTH > DATE '2000-06-01' AND CAST(l_shipdate AS DATE) <= DATE '2000-06-01') + bool_or(l_discount = 0)::INT AS INTEGER) AS children FROM lineitem GROUP BY l_orderkey""")
def children_counting(spark, d):
    rows = lines(spark, d).groupBy(F.col("l_orderkey").alias("profile_id")).agg(F.collect_list(F.col("l_shipdate").cast("date")).alias("births"), F.bool_or(F.col("l_discount") == 0).alias("pregnant"))
    return rows.select("profile_id", people.children_under(F.col("births"), F.lit(date(2000, 6, 1)), 36, F.col("pregnant").cast("int")).alias("children"))


# Merged notices


MEMBERS = "SELECT o_orderkey AS id, o_orderkey - o_orderkey % 3 AS canonical, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS member FROM orders WHERE o_orderkey - o_orderkey % 3 IN (SELECT o_orderkey FROM orders)"


def members(spark, d):
    """Orders in groups of three: the first is canonical; ids and sources are in the same order."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), k.cast("string").alias("external_id"), F.when(k % 3 > 0, k - k % 3).alias("duplicate_of_id"), F.lit(None).cast("long").alias("correction_of_id"),
        F.lit(None).cast("string").alias("correction_of_external_id"), F.col("o_orderpriority").alias("title"), F.lit("apt").alias("category"), F.when(k % 3 == 2, F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("no")).otherwise("unknown").alias("price_cap_status"),
        F.col("o_orderdate").cast("date").alias("announcement_date"), F.col("o_orderdate").cast("timestamp").alias("last_seen_at"),
    )
    return rows.withColumn("canonical_id", F.coalesce("duplicate_of_id", "id"))


@query(f"""WITH m AS ({MEMBERS}), e AS (SELECT DISTINCT canonical, l_returnflag, CAST(l_shipdate AS DATE) AS day FROM m JOIN lineitem ON l_orderkey = id), n AS (SELECT canonical, count(*) AS n_events, min(day) AS first_day FROM e GROUP BY 1),
p AS (SELECT canonical, unit, kind, bool_or(official) AS official FROM (SELECT canonical, l_partkey % 3 AS unit, l_linestatus AS kind, l_tax > 0.04 AS official FROM m JOIN lineitem ON l_orderkey = id) AS x GROUP BY 1, 2, 3), q AS (SELECT canonical, count(*) AS n_prices, count(*) FILTER (WHERE official) AS n_official FROM p GROUP BY 1),
r AS (SELECT canonical, count(DISTINCT l_suppkey % 4) AS n_rules FROM m JOIN lineitem ON l_orderkey = id GROUP BY 1), c AS (SELECT m.canonical, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS cap FROM m JOIN orders ON o_orderkey = m.id WHERE member = 2)
SELECT o_orderkey AS id, coalesce(cap, 'unknown') AS price_cap_status, n_events, first_day, n_prices, n_official, n_rules FROM orders LEFT JOIN c ON c.canonical = o_orderkey LEFT JOIN n ON n.canonical = o_orderkey LEFT JOIN q ON q.canonical = o_orderkey LEFT JOIN r ON r.canonical = o_orderkey WHERE o_orderkey % 3 = 0""")
def public_notices(spark, d):
    """One row for each canonical notice with the distinct events, prices (official ones first) and rules of its members, and the first cap that is told."""
    own = lines(spark, d)
    key, n = F.col("l_orderkey").alias("notice_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos")
    ev = own.select(key, n, F.col("l_returnflag").alias("kind"), F.lit("x").alias("label"), F.col("l_shipdate").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("string").alias("audience"))
    prices = own.select(
        key, n, (F.col("l_partkey") % 3).cast("string").alias("unit_type"), F.lit(84.0).alias("area_sqm"), F.col("l_linestatus").alias("price_kind"), F.lit(5).cast("long").alias("amount_krw"), F.lit(None).cast("long").alias("monthly_krw"),
        F.lit(None).cast("string").alias("basis_label"), F.when(F.col("l_tax") > 0.04, "official").otherwise("ai_unverified").alias("verification"),
    )
    k = (F.col("l_suppkey") % 4).cast("string")
    rule = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "a":1}'))).otherwise(F.concat(F.lit('{"a":1,"k":'), k, F.lit("}")))
    out = merged.public(members(spark, d), ev, prices, own.select(key, n, rule.alias("rule")))
    official = F.size(F.filter("prices", lambda p: p["verification"] == "official"))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return out.select("id", "price_cap_status", count("events").alias("n_events"), F.try_element_at("events", F.lit(1))["start_date"].alias("first_day"), count("prices").alias("n_prices"), F.when(F.col("prices").isNotNull(), official).cast("long").alias("n_official"), count("rules").alias("n_rules"))


@query(f"""WITH m AS ({MEMBERS}), s AS (SELECT m.*, o_custkey % 2 = 0 AS has_rows, CAST(o_orderdate AS TIMESTAMP) AS tried, o_orderkey % 5 = 0 AS bad FROM m JOIN orders ON o_orderkey = id),
best AS (SELECT canonical, id, has_rows, row_number() OVER (PARTITION BY canonical ORDER BY has_rows DESC, tried DESC, member) AS r FROM s), bad AS (SELECT canonical, bool_or(bad) AS bad, max(CASE WHEN has_rows THEN tried END) AS ok FROM s GROUP BY 1)
SELECT best.canonical AS canonical_id, CAST(best.id AS VARCHAR) AS chosen, CASE WHEN has_rows THEN 1 ELSE 0 END AS n_rows, bad AS proof_invalidated, CAST(ok AS DATE) AS last_success FROM best JOIN bad ON best.canonical = bad.canonical WHERE r = 1""")
def merged_results(spark, d):
    """Of a notice's members the one whose results are shown: one that has some, the latest attempt, the first; a correction of any counts."""
    orders, has = table(spark, d, "orders"), F.col("o_custkey") % 2 == 0
    at = F.col("o_orderdate").cast("timestamp")
    states = orders.select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderkey").cast("string").alias("status"), at.alias("attempted_at"), F.when(has, at).alias("succeeded_at"), has.alias("complete"), (F.col("o_orderkey") % 5 == 0).alias("proof_invalidated"))
    results = orders.filter(has).select(F.col("o_orderkey").alias("notice_id"), F.lit("84A").alias("unit_type"))
    rows = merged.merged_competition(merged.positions(members(spark, d).join(orders.select(F.col("o_orderkey").alias("canonical_id")), "canonical_id")), states, results)
    return rows.select("canonical_id", F.col("competition.status").alias("chosen"), F.coalesce(F.size("competitions"), F.lit(0)).alias("n_rows"), "proof_invalidated", F.col("last_success").cast("date").alias("last_success")).withColumn("n_rows", F.greatest("n_rows", F.lit(0)))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS notice_id, l_returnflag AS supply, l_linestatus = 'O' AS official, l_linenumber > 2 AS positive, l_partkey % 2 AS unit FROM lineitem), known AS (SELECT notice_id, bool_or(official) AS known FROM l GROUP BY 1), o AS (SELECT DISTINCT notice_id, supply, unit FROM l WHERE official AND positive)
SELECT o.notice_id, o.supply AS supply_type, CAST(o.unit AS VARCHAR) AS unit_type FROM o UNION ALL SELECT DISTINCT l.notice_id, l.supply, NULL FROM l JOIN known ON l.notice_id = known.notice_id JOIN orders ON o_orderkey = l.notice_id WHERE NOT known""")
def offered_combinations(spark, d):
    """What of a notice is judged: its official inventory where it is known, also where that is empty, else what its rules mention."""
    own = lines(spark, d).select(
        F.col("l_orderkey").alias("notice_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("int").alias("pos"), F.col("l_returnflag").alias("supply_type"), (F.col("l_partkey") % 2).cast("string").alias("unit_type"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).otherwise(0).cast("long").alias("count"), (F.col("l_linestatus") == "O").alias("official"),
    )
    scopes = own.select("notice_id", "supply_type", F.lit(None).cast("string").alias("unit_type"))
    return competition.combinations(notices(spark, d), merged.offered(own), scopes)


# Results and what they leave


@query("""WITH r AS (SELECT l_orderkey AS notice_id, CAST(l_partkey % 3 AS VARCHAR) AS unit, l_suppkey % 4 AS s, l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND l_linenumber < 5 AND l_linenumber <> 2), u AS (
  SELECT notice_id, unit, bool_or(s = 0) AS one, bool_or(s = 1 AND l_quantity >= 20) AS two FROM r GROUP BY 1, 2)
SELECT notice_id, unit, CASE WHEN one THEN 'local_first_closed' ELSE 'all_local_first' END AS proof FROM u WHERE one OR (two AND (notice_id % 2 = 0 OR (notice_id % 3 = 0 AND unit = '1')))""")
def closure_proof(spark, d):
    rows, full = results(spark, d), allocations(spark, d)
    return competition.closures(rows, full, F.timestamp_seconds(F.lit(36_000))).select("notice_id", "unit", "proof")


def results(spark, d):
    """Lines as result rows, some too old, of other areas, or with fewer applicants than homes."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey") % 4
    return lines(spark, d).select(
        F.col("l_orderkey").alias("notice_id"), F.concat((F.col("l_partkey") % 3).cast("string"), F.when(n % 2 == 0, ".").otherwise("")).alias("unit_type"), F.lit(1).alias("rank"), F.when(F.col("l_returnflag") == "N", "local").otherwise("other").alias("residence_area"),
        F.lit("general").alias("supply_type"), F.when(F.col("l_linestatus") == "O", "official").otherwise("unknown").alias("verification"), F.lit("u").alias("evidence_url"), F.timestamp_seconds(F.when(n == 2, 0).when(n < 5, 36_000).otherwise(40_000)).alias("observed_at"),
        F.when(s == 0, "local_first_closed").when(s == 1, "first_closed").otherwise("unknown").alias("result_status"), F.when(s == 1, "1순위 마감(청약 접수 종료)").alias("result_text"), F.lit(20).cast("long").alias("supply_count"), F.col("l_quantity").cast("long").alias("application_count"),
    )


def allocations(spark, d):
    k = F.col("o_orderkey")
    whole = table(spark, d, "orders").filter(k % 2 == 0).select(k.alias("notice_id"), F.lit(None).cast("string").alias("unit"), F.lit(100).alias("percent"))
    return whole.unionByName(table(spark, d, "orders").filter(k % 3 == 0).select(k.alias("notice_id"), F.lit("1.").alias("unit"), F.lit(100).alias("percent")))


@query("""WITH closed AS (SELECT DISTINCT l_orderkey AS notice_id, CAST(l_partkey % 3 AS VARCHAR) AS unit FROM lineitem WHERE l_returnflag <> 'N'), listed AS (SELECT DISTINCT l_orderkey AS notice_id, CAST(l_partkey % 3 AS VARCHAR) AS unit FROM lineitem), per AS (
  SELECT l.notice_id, string_agg(c.unit, ',' ORDER BY c.unit) AS closed, bool_and(c.unit IS NOT NULL) AS every FROM listed AS l LEFT JOIN closed AS c ON c.notice_id = l.notice_id AND c.unit = l.unit GROUP BY 1)
SELECT p.pid AS profile_id, o_orderkey AS notice_id, CASE WHEN pid = 1 THEN coalesce(closed, '') ELSE '' END AS closed_units, coalesce(pid = 1 AND every AND o_custkey % 3 > 0, FALSE) AS all_closed FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS p(pid) LEFT JOIN per ON per.notice_id = o_orderkey""")
def closure_decisions(spark, d):
    """What closed units mean for an applicant of another area and the first rank, one of the local area, and one of no known rank."""
    orders, unit = table(spark, d, "orders"), (F.col("l_partkey") % 3).cast("string")
    units = lines(spark, d).select(F.col("l_orderkey").alias("notice_id"), unit.alias("unit_type"))
    closed = lines(spark, d).filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("notice_id"), unit.alias("unit"), F.lit("x").alias("proof")).distinct()
    person = lambda i, area, rank: F.struct(F.lit(i).alias("profile_id"), F.lit(area).alias("area"), F.lit(rank).alias("rank"))
    applicants = orders.select(F.col("o_orderkey").alias("notice_id"), F.inline(F.array(person(1, "other", "first"), person(2, "local", "first"), person(3, "other", "unknown"))))
    now = F.timestamp_seconds(F.lit(36_000))
    states = orders.select(F.col("o_orderkey").alias("notice_id"), F.lit("ok").alias("status"), (F.col("o_custkey") % 3 > 0).alias("complete"), F.lit(False).alias("proof_invalidated"), now.alias("attempted_at"), now.alias("succeeded_at"))
    out = competition.decisions(applicants, units, closed, states, now)
    return out.withColumn("closed_units", F.array_join("closed_units", ","))


@query("""SELECT l_orderkey AS notice_id, CASE WHEN bool_and(l_quantity > 3) AND bool_or(l_linenumber = 1) AND bool_or(l_linenumber = 2) AND bool_or(l_linenumber = 3) AND l_orderkey % 5 > 0 THEN 'first' ELSE 'unknown' END AS rank,
  CASE l_orderkey % 4 WHEN 0 THEN 24 WHEN 1 THEN 12 WHEN 2 THEN 6 END AS months FROM lineitem GROUP BY l_orderkey""")
def first_ranks(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    rows = lines(spark, d).select(
        F.lit(1).alias("profile_id"), k.alias("notice_id"), F.when(n == 1, "account_type").when(n == 2, "subscription_months").when(n == 3, "deposit_min_krw").otherwise("household_head").alias("kind"),
        F.when(F.col("l_quantity") > 3, "pass").otherwise("review").alias("result"), (k % 5 > 0).alias("covered"),
    )
    none = F.lit(None).cast("boolean")
    months = competition.rank_months(F.when(F.col("notice_id") % 4 == 0, True).otherwise(F.when(F.col("notice_id") % 4 < 3, False)), F.lit(False), F.when(F.col("notice_id") % 4 == 1, True).when(F.col("notice_id") % 4 == 2, False).otherwise(none))
    return competition.first_rank(rows).select("notice_id", "rank", months.alias("months"))


JUDGED = """j AS (SELECT l_orderkey AS notice_id, CASE WHEN l_returnflag = 'N' THEN '일반공급' ELSE l_returnflag END AS supply, CAST(l_partkey % 2 AS VARCHAR) AS unit, CASE WHEN bool_or(l_quantity < 8) THEN 'mismatch' WHEN bool_or(l_quantity < 16) THEN 'review' ELSE 'possible' END AS status FROM lineitem GROUP BY 1, 2, 3)"""


def judged(spark, d):
    """One profile against combinations of supply and unit; a rule for each line, with the scope of its combination."""
    own = lines(spark, d)
    supply, unit = F.when(F.col("l_returnflag") == "N", "일반공급").otherwise(F.col("l_returnflag")), (F.col("l_partkey") % 2).cast("string")
    rule_id = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    rows = own.select(F.col("l_orderkey").alias("notice_id"), supply.alias("supply_type"), unit.alias("unit_type"), rule_id.alias("rule_id"), F.col("l_quantity").alias("q"))
    combos = rows.select("notice_id", "supply_type", "unit_type").distinct()
    own_rules = rows.select("notice_id", "rule_id", "supply_type", F.concat("unit_type", F.lit(".")).alias("unit_type"), F.lit(None).cast("array<string>").alias("unit_types"))
    outcome = rows.groupBy("rule_id").agg(F.min(F.when(F.col("q") < 8, 0).when(F.col("q") < 16, 1).otherwise(2)).alias("r"))
    outcome = outcome.select(F.lit(1).cast("long").alias("profile_id"), "rule_id", F.element_at(F.array(F.lit("fail"), F.lit("review"), F.lit("pass")), F.col("r") + 1).alias("result"))
    return evaluation.judged_combinations(combos, own_rules.dropDuplicates(["rule_id"]), outcome)


@query(f"WITH {JUDGED} SELECT notice_id, supply AS supply_type, unit AS unit_type, status FROM j")
def judged_combinations(spark, d):
    return judged(spark, d).select("notice_id", "supply_type", "unit_type", "status")


@query(f"""WITH {JUDGED}, c AS (SELECT *, CASE WHEN supply = '일반공급' AND (notice_id % 4 = 0 OR (notice_id % 4 = 1 AND unit = '1')) THEN 'mismatch' ELSE status END AS after FROM j)
SELECT o_orderkey AS notice_id, CASE WHEN count(after) = 0 THEN 'unpublished' WHEN bool_or(after = 'possible') THEN 'possible' WHEN bool_and(after = 'mismatch') THEN 'mismatch' ELSE 'review' END AS status FROM orders LEFT JOIN c ON notice_id = o_orderkey GROUP BY 1""")
def catalogue_statuses(spark, d):
    """The whole catalogue for a profile, after results have closed general supply; notices without rules are unpublished."""
    k = F.col("o_orderkey")
    closed = table(spark, d, "orders").select(F.lit(1).cast("long").alias("profile_id"), k.alias("notice_id"), F.when(k % 4 == 1, F.array(F.lit("1"))).alias("closed_units"), (k % 4 == 0).alias("all_closed"))
    out = evaluation.catalogue(evaluation.with_closures(judged(spark, d), closed), notices(spark, d))
    return out.select("notice_id", "status")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS notice_id, l_linenumber AS reason, l_returnflag AS supply FROM lineitem)
SELECT notice_id, reason AS rule_id, count(*) AS n_supplies FROM r GROUP BY 1, 2 HAVING count(*) > 1""")
def shared_reasons_having(spark, d):
    rows = dealt(lines(spark, d), "l_orderkey").groupBy(F.lit(1).alias("profile_id"), F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("supply_type")).agg(F.collect_set(F.struct(F.col("l_linenumber").alias("rule_id"), F.lit("pass").alias("result"))).alias("reasons"))
    return evaluation.shared_reasons(rows).select("notice_id", "rule_id", "n_supplies")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS n, l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'review' END AS result FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY n, result ORDER BY id) AS k FROM r), o AS (
  SELECT n, id, row_number() OVER (PARTITION BY n ORDER BY CASE WHEN k = 1 THEN CASE result WHEN 'fail' THEN 0 WHEN 'pass' THEN 1 ELSE 2 END ELSE 3 END, id) AS place FROM f)
SELECT n AS notice_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS shown FROM o WHERE place <= 3 GROUP BY 1""")
def brief_top3_per_status(spark, d):
    n = F.col("l_linenumber")
    reason = F.struct(n.alias("rule_id"), F.when(n % 3 == 0, "fail").when(n % 3 == 1, "pass").otherwise("review").alias("result"))
    rows = lines(spark, d).groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.array_sort(F.collect_set(reason)).alias("reasons"))
    return rows.select("notice_id", F.array_join(F.transform(evaluation.brief(F.col("reasons")), lambda r: r["rule_id"].cast("string")), ",").alias("shown"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS n, l_linestatus AS supply, l_returnflag AS method, CAST(l_partkey % 4 AS VARCHAR) AS unit FROM lineitem WHERE l_tax < 0.07), s AS (SELECT DISTINCT l_orderkey AS n, CAST(l_partkey % 4 AS VARCHAR) AS unit, l_partkey % 4 // 2 AS low FROM lineitem WHERE l_discount < 0.05)
SELECT m.n AS notice_id, supply AS supply_type, method, string_agg(DISTINCT m.unit, ',' ORDER BY m.unit) AS units, CASE WHEN min(low) = max(low) THEN min(low) END AS minimum FROM m LEFT JOIN s ON s.n = m.n AND s.unit = m.unit GROUP BY 1, 2, 3""")
def opportunity_groups(spark, d):
    own, unit = lines(spark, d), (F.col("l_partkey") % 4)
    methods = own.select(F.col("l_orderkey").alias("notice_id"), unit.cast("string").alias("unit_type"), F.col("l_linestatus").alias("supply_type"), F.col("l_returnflag").alias("method"), F.lit(40).alias("ratio"), F.lit("local").alias("area"), (F.col("l_tax") < 0.07).alias("official"))
    scores = own.filter("l_discount < 0.05").select(F.col("l_orderkey").alias("notice_id"), F.concat(unit.cast("string"), F.lit(".")).alias("unit_type"), F.lit("local").alias("area"), F.floor(unit / 2).alias("minimum"), F.lit(60).alias("average")).distinct()
    out = evaluation.opportunities(methods, scores)
    return out.select("notice_id", "supply_type", "method", F.array_join("units", ",").alias("units"), "minimum")


@query("""SELECT f AS field, g AS facts, CAST(n AS BIGINT) AS n_rules FROM (VALUES ('birth', 'person', 2), ('children', 'family', 1), ('homes', 'ownership', 1)) AS v(f, g, n)""")
def profile_questions(spark, d):
    given = [("a", '{"kind":"all","conditions":[{"kind":"children_min"},{"kind":"any","conditions":[{"kind":"age_min"},{"kind":"age_min"}]}]}'), ("b", '{"kind":"age_max","exceptions":[{"kind":"homeless"}]}'), ("c", '{"kind":"unparsed"}')]
    return evaluation.questions(rules.nodes(spark.createDataFrame(given, "rule_id string, rule string")))


@query("""WITH p AS (SELECT l_orderkey AS n, l_returnflag AS kind, l_linestatus = 'O' AS metadata, CASE WHEN l_linenumber = 2 THEN 'h' END AS hash, l_linenumber * 1000000 + l_partkey AS rule, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_tax < 0.04), i AS (SELECT l_orderkey AS n, l_returnflag AS kind, l_linenumber * 1000000 + l_partkey AS rule, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_tax > 0.05),
sent AS (SELECT DISTINCT n, kind FROM i), old AS (SELECT n, kind, min(day) AS day FROM p GROUP BY 1, 2)
SELECT p.n AS notice_id, rule, p.day AS original_date FROM p LEFT JOIN sent ON p.n = sent.n AND p.kind = sent.kind WHERE NOT metadata OR sent.n IS NULL OR hash = 'h' UNION ALL SELECT i.n, rule, least(i.day, coalesce(old.day, i.day)) FROM i LEFT JOIN old ON i.n = old.n AND i.kind = old.kind""")
def polled_rules(spark, d):
    """Rules after a poll: metadata of the kinds that it sends gives way, but for a document's; other rules stay; the original date only moves back."""
    rows = lines(spark, d).select(
        F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "O").alias("metadata"), F.when(F.col("l_linenumber") == 2, "h").alias("document_hash"), F.lit("official").alias("verification"),
        F.col("l_shipdate").cast("date").alias("original_date"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rule"), "l_tax",
    )
    incoming = rows.filter("l_tax > 0.05").drop("l_tax").withColumn("document_hash", F.lit(None).cast("string"))
    return evaluation.polled_rules(rows.filter("l_tax < 0.04").drop("l_tax"), incoming).select("notice_id", "rule", "original_date")


# Applicants


@query("""WITH m AS (SELECT l_orderkey AS p, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'child' WHEN 'N' THEN 'spouse_parent' ELSE 'sibling' END AS relation, CASE WHEN l_linestatus = 'O' THEN 'applicant' ELSE 'separate' END AS register FROM lineitem),
j AS (SELECT m.*, CASE WHEN relation = 'sibling' OR register = 'separate' THEN FALSE WHEN relation = 'spouse_parent' AND p % 3 <> 0 THEN NULL ELSE TRUE END AS inside FROM m), f AS (SELECT p, count(*) FILTER (WHERE inside) AS others, bool_or(inside IS NULL) AS open FROM j GROUP BY 1)
SELECT o_orderkey AS profile_id, CASE WHEN o_orderkey % 3 < 2 AND o_custkey % 4 > 0 AND NOT coalesce(open, FALSE) THEN CAST(coalesce(others, 0) + 1 AS INTEGER) END AS size, o_orderkey % 3 < 2 AND o_custkey % 4 > 0 AND NOT coalesce(open, FALSE) AS complete FROM orders LEFT JOIN f ON p = o_orderkey""")
def household_sizes(spark, d):
    k, flag = F.col("o_orderkey"), F.col("l_returnflag")
    profiles = table(spark, d, "orders").select(k.alias("profile_id"), (F.col("o_custkey") % 4 > 0).alias("on_register"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("has_spouse"), F.lit(True).alias("same_register"), F.lit(True).alias("roster_complete"))
    own = lines(spark, d).select(
        F.col("l_orderkey").alias("profile_id"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]).alias("member_id"),
        F.when(flag == "A", "child").when(flag == "N", "spouse_parent").otherwise("sibling").alias("relation"), F.when(F.col("l_linestatus") == "O", "applicant").otherwise("separate").alias("register"),
    )
    return people.households(own, profiles)


# Documents


DOCUMENT = ("거주기간 24개월 이상", "가입 후 12개월 경과", "납입인정횟수 6회 이상", "미성년 자녀 2명 이상", "혼인기간 7년 이내", "직계존속을 3년 이상 부양", "세대주로서 무주택세대구성원", "계약기간 : 2026.01.05 ~ 2026.01.07", "문의처", "만 19세 이상인 자", "2세 미만의 자녀가 있는 가구", "만 65세 이상의 직계존속을 3년 이상 계속하여 부양", "5년 이상 소득세 납부",
            "2주택 이상을 소유한 세대에 속하지 않을 것", "과거 5년 이내 당첨된 분의 세대에 속하지 않을 것", "세대구성원 모두 과거 주택을 소유한 사실이 없을 것", "청약통장 가입여부와 관계없이", "만 19세 미만의 자녀 2명 이상", "10년 이상 장기복무 군인")
KINDS = {0: [("residence_months", 24)], 1: [("subscription_months", 12)], 2: [("recognized_payments_min", 6)], 3: [("children_min", 2)], 4: [("marriage_months_max", 84)], 5: [("parent_support_months_min", 36)], 6: [("homeless", 1), ("household_head", 1)], 9: [("age_min", 19)], 10: [("newborn_children_min", 1)],
         11: [("parent_age_min", 65), ("parent_support_months_min", 36)], 12: [("tax_years_min", 5)], 13: [("ownership_count_max", 1)], 14: [("previous_winning_years", 5)], 15: [("never_owned_home", 1)], 16: [("account_not_required", 1)],
         17: [("young_children_min", 2), ("children_min", 2)], 18: [("military_service_years", 10)]}


def document_lines(spark, d):
    """notice_id, page, line, text: a published sentence for each line, and a heading that opens or closes a section before some."""
    n = ((F.col("l_suppkey") + F.col("l_partkey")) % len(DOCUMENT)).cast("int")
    pos = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    return lines(spark, d).select(F.col("l_orderkey").alias("notice_id"), F.lit(1).alias("page"), pos.alias("line"), F.element_at(F.array(*map(F.lit, DOCUMENT)), n + 1).alias("text"))


@query("""WITH l AS (SELECT l_orderkey AS n, (l_suppkey + l_partkey) % 19 AS k FROM lineitem), v(k, kind, value) AS (VALUES """ + ", ".join(f"({k}, '{kind}', {value})" for k, xs in KINDS.items() for kind, value in xs) + """)
SELECT n AS notice_id, kind, CAST(value AS BIGINT) AS value, count(*) AS n FROM l JOIN v ON v.k = l.k GROUP BY 1, 2, 3""")
def clause_extraction(spark, d):
    found = clauses.extract(document_lines(spark, d).withColumn("section", F.lit(None).cast("string"))).select("notice_id", F.explode("rules").alias("r"))
    return found.groupBy("notice_id", F.col("r.kind").alias("kind"), F.col("r.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN 'unranked_after' WHEN 2 THEN 'first_come' ELSE 'unknown' END AS method, CASE o_custkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'range' WHEN 2 THEN 'ongoing' END AS basis FROM orders)
SELECT n AS notice_id, method, basis, CASE WHEN basis IS NOT NULL THEN DATE '2026-01-05' END AS first_day, CASE basis WHEN 'range' THEN DATE '2026-01-07' END AS last_day FROM p""")
def document_headings(spark, d):
    """Application methods by the headings of the first pages, and contract schedules: a day, a range, from a day on, or two that differ."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 4
    head = F.when(k == 0, "무순위(사후) 입주자 모집공고").when(k == 1, "OO 아파트 입주자 모집 공고").when(k == 2, "선착순 동호 지정").otherwise("안내문")
    body = F.when(c == 0, "계약일 : 2026.01.05").when(c == 1, "계약체결 기간 2026년 1월 5일 ~ 2026.01.07").when(c == 2, "계약기간: 2026.01.05 부터 선착순").otherwise("계약일 2026.01.07 또는 2026.01.05")
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("notice_id"), F.explode(F.array(F.struct(F.lit(2).alias("page"), head.alias("text")), F.struct(F.lit(3).alias("page"), F.lit("선착순").alias("text")))).alias("p"), body.alias("body")).select("notice_id", "p.*", "body")
    plan = pages.filter("page = 2").select("notice_id", clauses.contract_schedule(F.col("body")).alias("s"))
    return clauses.application_method(pages, "notice_id").join(plan, "notice_id").select("notice_id", "method", F.col("s.basis").alias("basis"), F.col("s.start").alias("first_day"), F.col("s.end").alias("last_day"))


@query("""SELECT o_orderkey AS notice_id, CAST(4 AS INTEGER) AS n_tiers, CAST(o_custkey * 10000 AS BIGINT) AS smallest, CAST(60 AS INTEGER) AS low, CAST(o_custkey % 101 AS INTEGER) AS points FROM orders WHERE o_orderkey % 3 > 0""")
def deposit_tables(spark, d):
    """Deposit tables of four rows (one in three lacks one) and allocation bands whose shares make a hundred."""
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    p = (F.col("o_custkey") % 101).cast("string")
    texts = F.array(said("전용 85㎡ 이하 ", c, "만원 250만원"), F.lit("102㎡ 이하 600만원 400만원"), F.when(k % 3 > 0, "135㎡ 이하 1,000만원 700만원").otherwise("별도 문의"), F.lit("모든 면적 1,500만원 1,000만원"),
                    said("60㎡ 초과 85㎡ 이하 가점 ", p, "% 추첨 ", (100 - F.col("o_custkey") % 101).cast("string"), "%"), F.lit("85㎡ 초과 가점 50% 추첨 60%"))
    orders = table(spark, d, "orders")
    rows = orders.select(k.alias("notice_id"), F.lit(1).alias("page"), F.posexplode(texts).alias("line", "text"))
    deposit, bands = tables.deposit_table(rows, ["notice_id"], of=orders), tables.allocation_bands(rows, ["notice_id"], of=orders)
    smallest = F.element_at(F.filter("tiers", lambda t: t["max_area"] == 85)[0]["amounts"], 1)
    return deposit.join(bands, "notice_id").select("notice_id", F.size("tiers").alias("n_tiers"), smallest.alias("smallest"), "low", "points")


@query("""WITH r AS (SELECT o_orderkey AS n, o_custkey % 9 AS a FROM orders WHERE o_orderkey % 4 > 0)
SELECT n AS notice_id, '084.9500A' AS unit_type, '기관추천' AS supply_type, CAST(a AS BIGINT) AS supply_count FROM r WHERE a > 0 UNION ALL SELECT n, '084.9500A', '일반', 1000 FROM r UNION ALL SELECT n, '059.9500', '일반', 5 FROM r""")
def supply_tables(spark, d):
    """Supply tables whose rows make their totals; one row that doesn't retires a table; a unit's last row counts."""
    k, a = F.col("o_orderkey"), F.col("o_custkey") % 9
    cells = lambda *xs: F.array(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    row = lambda n, unit, counts: F.struct(F.lit(n).alias("row"), F.lit(unit).alias("unit"), counts.alias("counts"))
    total = F.when(k % 4 > 0, 1000 + a).otherwise(1)
    listed = F.array(row(0, "84.9500A", cells(a, "-", "-", "0", "0", "", "1,000", total)), row(1, "59.9500", cells("0", "0", "0", "0", "0", "0", "4", "4")), row(2, "59.9500", cells("0", "0", "0", "0", "0", "0", "5", "5")))
    rows = table(spark, d, "orders").select(k.alias("notice_id"), F.inline(listed))
    return tables.supplies(rows, ["notice_id"])



HOME = (
    "l_orderkey AS profile_id", "l_linenumber AS pos", "CASE l_returnflag WHEN 'A' THEN 'apartment' WHEN 'N' THEN 'detached' ELSE 'officetel' END AS kind", "CASE WHEN l_suppkey % 7 > 0 THEN 'applicant' END AS relation", "CAST(l_quantity * 2 AS DOUBLE) AS area_sqm",
    "CAST(l_partkey * 1000000 AS BIGINT) AS price_krw", "l_linestatus = 'O' AS capital", "l_linenumber = 1 AS only_home", "l_linenumber = 2 AS ascendant", "CASE WHEN l_linenumber = 2 THEN DATE '1960-01-01' ELSE DATE '1990-01-01' END AS owner_birth",
    "CASE WHEN l_tax > 0.06 THEN DATE '2026-09-01' ELSE DATE '2020-01-01' END AS acquired_on", "CASE WHEN l_discount > 0.08 THEN DATE '2026-02-01' END AS disposed_on", "CASE WHEN l_linenumber = 3 THEN l_partkey % 2 = 0 END AS dormitory",
)


@query(f"""WITH h AS (SELECT {', '.join(HOME)} FROM lineitem), j AS (SELECT *, CASE WHEN kind = 'officetel' THEN FALSE WHEN relation IS NULL THEN NULL WHEN acquired_on > DATE '2026-07-01' THEN FALSE WHEN disposed_on IS NOT NULL THEN FALSE
    WHEN only_home AND area_sqm <= 20 THEN FALSE WHEN ascendant THEN FALSE WHEN only_home AND CASE WHEN kind = 'apartment' THEN area_sqm <= 60 AND price_krw <= CASE WHEN capital THEN 160000000 ELSE 100000000 END ELSE area_sqm <= 85 AND price_krw <= CASE WHEN capital THEN 500000000 ELSE 300000000 END END THEN FALSE
    WHEN pos = 3 AND dormitory THEN FALSE WHEN pos <> 3 THEN NULL ELSE TRUE END AS counts FROM h), f AS (SELECT profile_id, bool_or(counts) AS has_home, bool_or(counts IS NULL) AS unsure FROM j GROUP BY 1)
SELECT o_orderkey AS profile_id, CASE WHEN has_home THEN FALSE WHEN coalesce(unsure, FALSE) THEN NULL ELSE TRUE END AS homeless FROM orders LEFT JOIN f ON profile_id = o_orderkey""")
def homeless_applicants(spark, d):
    """Homes by the statutory clauses (dormitories are told of every third alone), and who has none that counts."""
    rows = table(spark, d, "lineitem").selectExpr(*HOME)
    no = F.lit(False)
    rest = ("rural_detached lived_and_moved first_domicile_inherited inherited_share developer sale_completed policy_home gone_or_other_use unauthorised_old lawful_evidence residual_right_first auction_of_own_rental first_home_2024 public_rental elder_supply").split()
    home = {c: F.col(c) for c in ("kind", "relation", "area_sqm", "price_krw", "capital", "only_home", "ascendant", "owner_birth", "acquired_on", "disposed_on", "dormitory")} | {c: no for c in rest}
    home |= {"acquired_by": F.lit("purchase"), "age_years": F.lit(5), "noticed_on": F.lit(None).cast("date"), "corrected_on": F.lit(None).cast("date"), "tenant_months": F.lit(0), "today": F.lit(date(2026, 12, 1))}
    counted = people.counts_as_home(home, F.lit(date(2026, 7, 1)))
    profiles = table(spark, d, "orders").select(F.col("o_orderkey").alias("profile_id"))
    return people.homeless(rows, profiles, counted)


@query("""WITH s AS (SELECT o_orderkey AS n, o_orderkey % 6 AS k, o_custkey % 101 AS a FROM orders)
SELECT n AS notice_id, CASE k WHEN 0 THEN 'institution' WHEN 1 THEN 'region_priority' ELSE 'regional_quota' END AS method, CASE k WHEN 1 THEN '성남시' END AS local_region, CASE k WHEN 2 THEN CAST(a AS INTEGER) END AS local_percent, CASE WHEN n % 2 = 0 THEN '소득>지역>추첨' END AS steps,
  CASE WHEN n % 5 = 0 THEN 2 END AS lottery_stage, n % 7 = 0 AS advance, CAST(CASE k WHEN 1 THEN 3 ELSE 2 END AS INTEGER) AS page FROM s WHERE k < 3""")
def special_selections(spark, d):
    """How special supplies choose winners: by institution, region or quota; some shares make no hundred, some supplies offer nothing, some are general."""
    k, o, a = F.col("o_orderkey") % 6, F.col("o_orderkey"), F.col("o_custkey") % 101
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    supply = F.when(k == 0, "기관추천 특별공급").when(k == 5, "일반공급").otherwise("다자녀가구 특별공급")
    region = said("② 지역 : 해당지역 거주자(성남시 거주자) → 기타지역 거주자(경기도)")
    quota = lambda rest: said("② 지역 : 해당시·도 거주자 ", a, "%(경기도) → 기타지역 거주자 ", rest, "%(서울)")
    main = F.when(k == 0, "해당기관의 장이 정하는 우선순위에 따라 공급").when(k.isin(1, 4, 5), region).when(k == 2, quota(100 - a)).otherwise(quota(101 - a))
    more = F.concat_ws(" ", F.when(o % 2 == 0, "당첨자 선정 순서 : ① 소득 → ② 지역 → ③ 추첨"), F.lit("※"), F.when(o % 5 == 0, "2단계에서 경쟁이 있는 경우 순위와 관계없이 해당지역 거주자(성남시)에게"), F.when(o % 7 == 0, "각 단계별 낙첨자는 다음 단계 공급대상에 포함됨"))
    pages = F.array(F.struct(F.lit(4).alias("page"), more.alias("text")), F.struct(F.when(k == 1, 3).otherwise(2).alias("page"), main.alias("text")))
    sections = table(spark, d, "orders").select(o.alias("notice_id"), supply.alias("supply_type"), F.inline(pages))
    inventory = table(spark, d, "orders").select(o.alias("notice_id"), supply.alias("supply_type"), F.lit("84A").alias("unit_type"), F.when(k == 4, 0).otherwise(5).alias("supply_count"))
    return tables.special_selection(sections, inventory).withColumn("steps", F.array_join("steps", ">")).drop("supply_type")


@query("""SELECT o_orderkey AS notice_id, CASE WHEN o_custkey % 3 = 0 THEN 'local=50,other=50' WHEN o_custkey % 3 = 1 THEN 'local=30,other_gyeonggi=20,other=50' END AS shares FROM orders""")
def quota_tables(spark, d):
    c = F.col("o_custkey") % 3
    said = F.when(c == 0, "해당지역 거주자 50% 기타지역 50%").when(c == 1, "해당 주택건설지역 30% 기타 경기지역 20 % 기타지역 50%").otherwise("해당지역 50% 기타지역 40%")
    shares = tables.regional_shares(said)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("notice_id"), F.array_join(F.transform(shares, lambda s: F.concat_ws("=", s["residence_area"], s["percent"].cast("string"))), ",").alias("shares"))


@query(f"""WITH {JUDGED}, s AS (SELECT DISTINCT notice_id, supply, status FROM j)
SELECT notice_id, supply AS supply_type, status, row_number() OVER (PARTITION BY notice_id ORDER BY supply = '일반공급' DESC, CASE supply WHEN 'R' THEN 0 ELSE 1 END, status) AS place FROM s""")
def ordered_summaries(spark, d):
    """Supplies of a notice, general supply first, then in the order of its inventory."""
    rows = judged(spark, d).drop("reasons").withColumn("reasons", F.array(F.lit("x")))
    out = evaluation.summaries(rows).withColumn("pos", F.when(F.col("supply_type") == "R", 0).otherwise(1))
    return evaluation.in_order(out).select("notice_id", "supply_type", "status", "place")


@query("""WITH s AS (SELECT l_orderkey AS n, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linestatus)) AS states FROM lineitem GROUP BY 1)
SELECT n AS notice_id, list_contains(flags, 'A') AND list_contains(flags, 'R') AS both_kinds, array_to_string(list_sort(list_intersect(flags, ['A', 'N', 'X'])), ',') AS shared FROM s""")
def set_tests(spark, d):
    from noticeloom.operators.consensus import common, covers

    rows = lines(spark, d).groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.collect_set("l_returnflag").alias("flags"))
    return rows.select("notice_id", covers(F.col("flags"), F.array(F.lit("R"), F.lit("A"))).alias("both_kinds"), F.array_join(common(F.col("flags"), F.array(F.lit("X"), F.lit("N"), F.lit("A"))), ",").alias("shared"))


@query("""SELECT o_orderkey AS id, CAST(o_totalprice AS BIGINT) AS amount, CAST(NULL AS DATE) AS added, o_orderstatus AS status FROM orders""".replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)"))
def conformed_rows(spark, d):
    """An older table in the schema of a newer one."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("id long, amount long, added date, status string")
    return store.conformed(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("gone")), schema)
