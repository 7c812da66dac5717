"""Revisions, states and facts over time."""

from pyspark.sql import functions as F

from noticeloom.operators.history import asof_latest, coverage, fresh, latest, retained, versions
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table


@query("""WITH turns AS (SELECT conv_id, turn, role, sha256(role || '|' || (length(text) // 200)) AS content_hash FROM conversations),
changed AS (SELECT *, lag(content_hash) OVER (PARTITION BY conv_id ORDER BY turn, role) AS last FROM turns)
SELECT conv_id, turn, role, content_hash, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS version FROM changed WHERE last IS DISTINCT FROM content_hash""")
def scd2_versions(spark, d):
    log = table(spark, d, "conversations")
    content = F.concat_ws("|", "role", F.floor(F.length("text") / 200).cast("string"))
    return versions(log, ["conv_id"], ["turn", "role"], content).select("conv_id", "turn", "role", "content_hash", F.col("version").cast("long"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations) AS x WHERE r = 1""")
def latest_revision(spark, d):
    return latest(table(spark, d, "conversations"), ["conv_id"], F.col("turn").desc(), F.col("role")).select("conv_id", "turn", "role")


NOW = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"""SELECT user_id, coalesce(max(ts) FILTER (WHERE event_type = 'purchase') >= max(ts) FILTER (WHERE event_type IN ('purchase', 'error'))
  AND max(ts) FILTER (WHERE event_type = 'purchase') BETWEEN {NOW} - INTERVAL 48 HOUR AND {NOW} + INTERVAL 60 SECOND
  AND NOT bool_or(event_type = 'error' AND value > 190), FALSE) AS is_fresh FROM events WHERE ts <= {NOW} GROUP BY user_id""")
def freshness_ttl(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).filter(F.expr(f"ts <= TIMESTAMP_NTZ '2024-01-30 12:00:00'"))
    good, bad = F.col("event_type") == "purchase", F.col("event_type") == "error"
    state = rows.groupBy("user_id").agg(F.max(F.when(good | bad, F.col("ts"))).alias("attempted"), F.max(F.when(good, F.col("ts"))).alias("succeeded"), F.bool_or(bad & (F.col("value") > 190)).alias("invalidated"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'")
    return state.select("user_id", fresh(F.lit("ok"), F.col("invalidated"), F.col("attempted"), F.col("succeeded"), now, "48 hours").alias("is_fresh"))


SOURCES = ["purchase", "view", "imported"]


@query("""WITH log AS (SELECT event_type AS source, CASE WHEN value < 20 THEN 'failed' WHEN value < 30 THEN 'partial' ELSE 'ok' END AS status, ts AS attempted_at, CAST(floor(value) AS BIGINT) AS record_count, event_id FROM events),
state AS (SELECT source, arg_max(status, (attempted_at, status)) AS status, max(attempted_at) AS last_attempt, max(attempted_at) FILTER (WHERE status <> 'failed') AS last_success,
  arg_max(record_count, (attempted_at, record_count)) FILTER (WHERE status <> 'failed') AS record_count FROM log GROUP BY source),
known AS (SELECT * FROM (VALUES ('purchase', 0), ('view', 1), ('imported', 2)) AS v(source, position))
SELECT coalesce(k.source, s.source) AS source, coalesce(s.status, 'never') AS status, epoch_us(s.last_attempt) AS last_attempt, epoch_us(s.last_success) AS last_success,
  coalesce(s.record_count, 0) AS record_count, coalesce(k.position, 3) AS position FROM known AS k FULL JOIN state AS s ON k.source = s.source""")
def coverage_status(spark, d):
    status = F.when(F.col("value") < 20, "failed").when(F.col("value") < 30, "partial").otherwise("ok")
    log = table(spark, d, "events").select(F.col("event_type").alias("source"), status.alias("status"), F.col("ts").cast("timestamp").alias("attempted_at"), F.floor("value").cast("long").alias("record_count"))
    out = coverage(log, SOURCES)
    return out.withColumn("last_attempt", F.unix_micros("last_attempt")).withColumn("last_success", F.unix_micros("last_success"))


@query("""SELECT event_id, user_id, max(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY user_id, grp) AS last_value FROM (
  SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events) AS x""")
def retained_success(spark, d):
    out = retained(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), F.col("event_type") == "purchase", "last_value")
    return out.select("event_id", "user_id", "last_value")


@query("""SELECT q.event_id, q.user_id, max_by(s.value, (s.ts, s.value)) AS fact FROM events AS q
  LEFT JOIN events AS s ON q.user_id = s.user_id AND s.event_type = 'signup' AND s.ts < q.ts
WHERE q.event_type = 'error' GROUP BY q.event_id, q.user_id""")
def temporal_fact_asof(spark, d):
    rows = table(spark, d, "events")
    left = rows.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = rows.filter("event_type = 'signup'").select("user_id", "ts", "value")
    return asof_latest(left, right, ["user_id"], "ts", "ts", ["value"]).select("event_id", "user_id", F.col("asof_value").alias("fact"))
