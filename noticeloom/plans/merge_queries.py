"""Merging of rows of one entity: consensus, first and best rows, entity resolution, placeholders."""

from pyspark.sql import functions as F

from noticeloom.operators.consensus import agreed, best_row, conflicting, distinct_ordered, preferring, same_sets
from noticeloom.operators.entities import clusters, prefix_references
from noticeloom.operators.history import asof_latest
from noticeloom.plans.registry import query
from noticeloom.plans.tables import notices, table


@query("""SELECT p_name || ':' || p_partkey AS external_id, ref, resolved FROM (
  SELECT p_name, p_partkey, p_brand || ':' || p_size AS ref FROM part) AS x
  LEFT JOIN (SELECT ref AS r, min(k) AS resolved FROM (
    SELECT a.ref, b.k FROM (SELECT DISTINCT p_brand || ':' || p_size AS ref FROM part) AS a
    JOIN (SELECT p_brand || ':' || p_size || ':' || p_partkey AS k FROM part) AS b ON starts_with(b.k, a.ref || ':')) AS m
  GROUP BY ref HAVING count(*) = 1) AS y ON x.ref = y.r""")
def prefix_reference_resolution(spark, d):
    own = F.concat_ws(":", "p_brand", F.col("p_size").cast("string"))
    part = table(spark, d, "part").select(F.concat_ws(":", "p_name", F.col("p_partkey").cast("string")).alias("external_id"), own.alias("ref"), F.concat_ws(":", own, F.col("p_partkey").cast("string")).alias("key"))
    return prefix_references(part, "ref", part.select("key"), "key").select("external_id", "ref", "resolved")


@query("""SELECT c.id, max_by(o.id, (o.announcement_date, o.id)) AS original FROM
  (SELECT o_orderkey AS id, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS announcement_date FROM orders) AS c
  LEFT JOIN (SELECT o_orderkey AS id, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS announcement_date FROM orders) AS o
    ON c.o_custkey = o.o_custkey AND c.o_orderpriority = o.o_orderpriority AND o.announcement_date < c.announcement_date
GROUP BY c.id""")
def asof_correction_link(spark, d):
    rows = notices(spark, d).select("id", "provider", "category", "announcement_date")
    found = asof_latest(rows, rows, ["provider", "category"], "announcement_date", "announcement_date", ["id"])
    return found.select("id", F.col("asof_id").alias("original"))


@query("""WITH keyed AS (SELECT doc_id, sha256(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) AS fingerprint FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY fingerprint) AS canonical_id, count(*) OVER (PARTITION BY fingerprint) AS members FROM keyed""")
def duplicate_clusters(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), "[^0-9a-z]", ""), 256).alias("fingerprint"))
    return clusters(docs, "fingerprint", "doc_id")


@query("""SELECT source, lang, doc_id, quality FROM (
  SELECT d.source, d.lang, d.doc_id, l.quality, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY (l.doc_id IS NOT NULL) DESC, d.doc_id) AS r
  FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id) AS x WHERE r = 1""")
def dedup_official_first(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", "doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return best_row(rows, ["source", "lang"], F.col("quality").isNull(), F.col("doc_id")).select("source", "lang", "doc_id", "quality")


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY first_id) AS journey FROM (
  SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS first_id FROM events GROUP BY 1, 2, 3) AS x GROUP BY user_id""")
def ordered_event_dedup(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id")
    first = distinct_ordered(rows, ["user_id"], ["event_type", "day"], F.col("event_id"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ">").alias("journey"))


@query("""SELECT l_orderkey AS notice_id,
  CASE WHEN count(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'O') = 1 THEN min(l_returnflag) FILTER (WHERE l_linestatus = 'O') END AS flag,
  coalesce(count(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'O') > 1, FALSE) AS conflict,
  CASE WHEN count(DISTINCT l_discount > 0.05) FILTER (WHERE l_linestatus = 'O') = 1 THEN bool_and(l_discount > 0.05) FILTER (WHERE l_linestatus = 'O') END AS regulated
FROM lineitem GROUP BY l_orderkey""")
def consensus_flag(spark, d):
    official = F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("notice_id")).agg(
        agreed(F.col("l_returnflag"), official).alias("flag"), conflicting(F.col("l_returnflag"), official).alias("conflict"), agreed(F.col("l_discount") > 0.05, official).alias("regulated"),
    )


@query("""SELECT l_orderkey AS notice_id, bool_or(l_tax >= 0.06) AS preferred,
  CASE WHEN bool_or(l_tax >= 0.06) THEN CASE WHEN count(DISTINCT l_linestatus) FILTER (WHERE l_tax >= 0.06) = 1 THEN min(l_linestatus) FILTER (WHERE l_tax >= 0.06) END
    WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS method
FROM lineitem GROUP BY l_orderkey""")
def consensus_prefer_document(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "notice_id")
    return preferring(rows, ["notice_id"], F.col("l_tax") >= 0.06, F.col("l_linestatus"), "method")


@query("""SELECT notice_id, supply, count FROM (
  SELECT l_orderkey AS notice_id, l_returnflag AS supply, CAST(l_quantity AS BIGINT) AS count,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) AS r
  FROM lineitem WHERE l_quantity > 5) AS x WHERE r = 1""")
def offered_first_wins(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity > 5")
    rows = rows.select(F.col("l_orderkey").alias("notice_id"), F.col("l_returnflag").alias("supply"), F.col("l_quantity").cast("long").alias("count"), "l_linenumber", "l_partkey")
    return best_row(rows, ["notice_id", "supply"], F.col("l_linenumber"), F.col("l_partkey"), F.col("count")).select("notice_id", "supply", "count")


@query("""WITH expected AS (SELECT list_sort(list(DISTINCT l_linestatus)) AS e FROM lineitem), units AS (
  SELECT l_orderkey AS notice_id, list_sort(list(DISTINCT l_linestatus)) AS u, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS both_areas FROM lineitem GROUP BY l_orderkey)
SELECT notice_id, u = e AS observed_all, u = e AND both_areas AS complete, CAST(len(u) AS INTEGER) AS n_units FROM units, expected""")
def completeness_set_equality(spark, d):
    rows = table(spark, d, "lineitem")
    expected = rows.agg(F.collect_set("l_linestatus")).scalar()
    units = rows.groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.collect_set("l_linestatus").alias("u"), (F.bool_or(F.col("l_returnflag") == "A") & F.bool_or(F.col("l_returnflag") == "R")).alias("both"))
    same = same_sets(F.col("u"), expected)
    return units.select("notice_id", same.alias("observed_all"), (same & F.col("both")).alias("complete"), F.size("u").alias("n_units"))


@query("""SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC NULLS LAST, event_id) AS r FROM events) AS x WHERE r = 1""")
def argmax_with_preference(spark, d):
    rows = table(spark, d, "events")
    return best_row(rows, ["user_id"], (F.col("event_type") == "purchase").desc(), F.col("ts").desc_nulls_last(), F.col("event_id")).select("user_id", "event_id", "event_type", "value")
