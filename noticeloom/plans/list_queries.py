"""Lists of notices: windows, supersession, pages, calendars."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.operators.windows import application_summary, density, in_window, is_application, is_open_ended, of_any_case, page
from noticeloom.plans.registry import query
from noticeloom.plans.tables import EVENTS_SQL, NOTICES_SQL, events, notices

FIRST, LAST = date(1996, 1, 1), date(1996, 3, 31)
OPEN_SQL = "(end_date IS NULL AND label = '상시 접수')"
SUMMARY_SQL = f"""summary AS (
  SELECT notice_id, count(*) AS n_applications,
    count(*) FILTER (WHERE start_date <= DATE '1996-03-31' AND ({OPEN_SQL} OR coalesce(end_date, start_date) >= DATE '1996-01-01')) AS hits,
    min(start_date) AS first_start, CASE WHEN bool_or({OPEN_SQL}) THEN NULL ELSE max(coalesce(end_date, start_date)) END AS last_end,
    min(greatest(start_date, DATE '1996-01-01')) FILTER (WHERE NOT {OPEN_SQL} AND start_date <= DATE '1996-03-31' AND coalesce(end_date, start_date) >= DATE '1996-01-01') AS first_hit,
    min(start_date) FILTER (WHERE {OPEN_SQL}) AS open_from
  FROM notice_events WHERE kind NOT IN ('announcement', 'contract', 'result', 'winner') GROUP BY notice_id)"""
LISTED_SQL = f"""WITH {NOTICES_SQL}, {EVENTS_SQL}, {SUMMARY_SQL}, listed AS (
  SELECT n.*, s.last_end AS application_end_date,
    coalesce(s.first_hit, CASE WHEN NOT coalesce(s.open_from <= DATE '1996-03-31', FALSE) THEN coalesce(s.first_start, n.announcement_date) END) AS sort_date
  FROM notices AS n LEFT JOIN summary AS s ON n.id = s.notice_id
  WHERE coalesce(s.hits > 0, FALSE) OR (s.notice_id IS NULL AND n.announcement_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'))"""


@query(f"""{LISTED_SQL}
SELECT id, title, sort_date, application_end_date, (SELECT count(*) FROM listed) AS total
FROM listed ORDER BY sort_date ASC NULLS LAST, title, id LIMIT 20 OFFSET 20""")
def notice_window_list(spark, d):
    rows = in_window(notices(spark, d), events(spark, d), FIRST, LAST)
    return page(rows.select("id", "title", "sort_date", "application_end_date"), 2, 20, F.col("sort_date").asc_nulls_last(), F.col("title"), F.col("id"))


@query(f"""WITH {NOTICES_SQL}, {EVENTS_SQL}
SELECT id, category FROM notices AS n WHERE category IN ('1-URGENT', '2-HIGH') AND EXISTS (
  SELECT 1 FROM notice_events AS e WHERE e.notice_id = n.id AND e.kind = 'general' AND e.start_date <= DATE '1996-03-31'
    AND ({OPEN_SQL} OR coalesce(e.end_date, e.start_date) >= DATE '1996-01-01'))""")
def application_only_list(spark, d):
    rows = in_window(notices(spark, d).filter(F.col("category").isin("1-URGENT", "2-HIGH")), events(spark, d), FIRST, LAST, application_only=True)
    return rows.select("id", "category")


@query(f"""WITH {NOTICES_SQL}, {EVENTS_SQL}, {SUMMARY_SQL}, shown AS (
  SELECT n.id, n.title, s.last_end AS application_end_date FROM notices AS n JOIN summary AS s ON n.id = s.notice_id
  WHERE s.hits > 0 AND EXISTS (SELECT 1 FROM notice_events AS r WHERE r.notice_id = n.id AND r.kind = 'contract'))
SELECT *, (SELECT count(*) FROM shown) AS total FROM shown ORDER BY application_end_date DESC NULLS LAST, title, id LIMIT 50""")
def results_view(spark, d):
    own = events(spark, d)
    rows = in_window(notices(spark, d), own, FIRST, LAST, application_only=True)
    rows = rows.join(own.filter(~is_application(F.col("kind"))).select("notice_id"), F.col("id") == F.col("notice_id"), "left_semi")
    return page(rows.select("id", "title", "application_end_date"), 1, 50, F.col("application_end_date").desc_nulls_last(), F.col("title"), F.col("id"))


@query(f"""WITH {EVENTS_SQL}
SELECT notice_id, count(*) AS n_applications, min(start_date) AS first_start,
  CASE WHEN bool_or({OPEN_SQL}) THEN NULL ELSE max(coalesce(end_date, start_date)) END AS last_end,
  min(coalesce(end_date, start_date)) FILTER (WHERE coalesce(end_date, start_date) >= DATE '1998-06-01') AS next_deadline
FROM notice_events WHERE kind = 'general' GROUP BY notice_id""")
def sort_and_end_dates(spark, d):
    own = events(spark, d)
    due = F.coalesce("end_date", "start_date")
    next_deadline = own.filter(is_application(F.col("kind"))).groupBy("notice_id").agg(F.min(F.when(due >= date(1998, 6, 1), due)).alias("next_deadline"))
    return application_summary(own, None, None).join(next_deadline, "notice_id").select("notice_id", "n_applications", "first_start", "last_end", "next_deadline")


@query(f"""WITH {EVENTS_SQL}, days AS (
  SELECT CAST(unnest(generate_series(greatest(start_date, DATE '1997-01-01'), least(coalesce(end_date, start_date), DATE '1997-12-31'), INTERVAL 1 DAY)) AS DATE) AS day,
    label = '접수' AS unavailable FROM notice_events
  WHERE kind = 'general' AND start_date <= DATE '1997-12-31' AND coalesce(end_date, start_date) >= DATE '1997-01-01')
SELECT day, count(*) AS n, bool_and(unavailable) AS all_unavailable FROM days GROUP BY day""")
def calendar_density(spark, d):
    own = events(spark, d).filter(is_application(F.col("kind")))
    return density(own, date(1997, 1, 1), date(1997, 12, 31), F.col("label") == "접수")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT *, CASE WHEN pos = 1 AND kind = 'contract' THEN 'Contract' WHEN pos = 2 AND kind = 'general' THEN 'General' ELSE kind END AS written FROM notice_events)
SELECT notice_id, count(*) FILTER (WHERE written <> 'contract') AS n_applications, count(*) FILTER (WHERE lower(written) <> 'contract') AS n_receptions, count(*) FILTER (WHERE lower(written) <> 'contract' AND {OPEN_SQL}) AS n_open FROM e GROUP BY notice_id""")
def kinds_as_written(spark, d):
    """Kinds with capitals: an application for lists, which take kinds as written, and none for open ends and screens, which don't."""
    kind = F.when((F.col("pos") == 1) & (F.col("kind") == "contract"), "Contract").when((F.col("pos") == 2) & (F.col("kind") == "general"), "General").otherwise(F.col("kind"))
    own = events(spark, d).withColumn("kind", kind)
    count = lambda test: F.count(F.when(test, 1))
    return own.groupBy("notice_id").agg(
        count(is_application(F.col("kind"))).alias("n_applications"), count(of_any_case(F.col("kind"))).alias("n_receptions"), count(is_open_ended(F.col("kind"), F.col("label"), F.col("end_date"))).alias("n_open"),
    )
