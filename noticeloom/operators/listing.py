"""What a screen of notices shows: receptions, filters, order, changes since the last fetch, counters and targets of work."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.operators.windows import NOT_OPEN, is_application, is_open_ended, of_any_case

# Sale categories, the days for which a notice stays active, the days around today in which results are polled.
SALES = ("apt", "private_sale", "public_sale", "unsold", "optional_supply")
ACTIVE_DAYS, BACK, AHEAD = 45, 90, 90
TARGETS = 100


def is_reception(event: Column) -> Column:
    """Events (struct with kind and label) that are applications, whatever the case of the kind, and whose label doesn't say otherwise."""
    return of_any_case(event["kind"]) & ~F.coalesce(event["label"], F.lit("")).rlike(NOT_OPEN)


def reception_end(event: Column) -> Column:
    """The last day of a reception, or null while it is open-ended."""
    return F.when(~is_open_ended(event["kind"], event["label"], event["end_date"]), F.coalesce(event["end_date"], event["start_date"]))


def reception_overlaps(event: Column, first: Column, last: Column) -> Column:
    return is_reception(event) & (event["start_date"] <= last) & F.coalesce(reception_end(event) >= first, F.lit(True))


def active_receptions(events: Column, today: Column) -> Column:
    return F.filter(events, lambda e: reception_overlaps(e, today, today))


def is_active(events: Column, announced: Column, today: Column) -> Column:
    """An event that ends today or later, or an announcement of the last ACTIVE_DAYS days."""
    later = F.exists(events, lambda e: F.coalesce(e["end_date"], e["start_date"]) >= today)
    return F.coalesce(later, F.lit(False)) | F.coalesce(announced >= F.date_sub(today, ACTIVE_DAYS), F.lit(False))


def results_due(events: Column, has_results: Column, by_rank: Column, today: Column) -> Column:
    """Whether results may be published: there are some; or all receptions have ended; or one has begun, of ranked
    notices that of the first rank for local applicants."""
    receptions = F.filter(events, lambda e: is_application(e["kind"]))
    over = (F.size(receptions) > 0) & F.forall(receptions, lambda e: F.coalesce(reception_end(e) < today, F.lit(False)))
    local = F.exists(receptions, lambda e: (e["kind"] == "first_priority") & (e["audience"] == "해당지역") & (e["start_date"] <= today))
    begun = F.exists(receptions, lambda e: e["start_date"] <= today)
    return has_results | F.coalesce(over | F.when(by_rank, local).otherwise(begun), F.lit(False))


def polled(notices: DataFrame, today: Column, lookback: int = 180, lookahead: int = 60) -> DataFrame:
    """Notices (announcement_date, events) whose results are asked for again: a reception that ends BACK days ago or later and begins
    AHEAD days from now or sooner; announced from lookback days ago to lookahead days from now."""
    near = lambda e: is_application(e["kind"]) & (F.coalesce(e["end_date"], e["start_date"]) >= F.date_sub(today, BACK)) & (e["start_date"] <= F.date_add(today, AHEAD))
    return notices.filter(F.exists("events", near) & F.col("announcement_date").between(F.date_sub(today, lookback), F.date_add(today, lookahead)))


def shown(notices: DataFrame, first: Column, last: Column, category: str | None = None, cap_only: bool = False, day: Column | None = None) -> DataFrame:
    """Notices (category, price_cap_status, events) that a screen shows: no public rentals, a reception in the range, of the category,
    under the cap, with an event on the chosen day."""
    rows = notices.filter(~F.lower("category").eqNullSafe("public_rental") & ~F.coalesce(F.col("category").contains("공공임대"), F.lit(False)))
    rows = rows.filter(F.exists("events", lambda e: reception_overlaps(e, first, last)))
    rows = rows if category is None else rows.filter(F.col("category") == category)
    rows = rows.filter("price_cap_status = 'yes'") if cap_only else rows
    return rows if day is None else rows.filter(F.exists("events", lambda e: (e["start_date"] <= day) & (F.coalesce(e["end_date"], e["start_date"]) >= day)))


def in_order(rows: DataFrame, candidates_first: bool = True) -> DataFrame:
    """Rows (day, candidate, title, id) by day, candidates first, titles in Korean order, then id."""
    lead = [F.col("candidate").desc()] if candidates_first else []
    return rows.orderBy(F.col("day").asc_nulls_last(), *lead, F.collate("title", "ko"), "id")


def latest_of(*catalogues: DataFrame) -> DataFrame:
    """Rows of several catalogues (id, ...), one for each id: that of the last catalogue that has it."""
    rows = None
    for i, x in enumerate(catalogues):
        part = x.withColumn("_from", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("id").orderBy(F.col("_from").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_from")


def unchanged(before: DataFrame, now: DataFrame) -> DataFrame:
    """now (id, ...) with reused: whether the row before says exactly the same, field by field."""
    fields = [c for c in now.columns if c != "id"]
    content = lambda rows: F.sha2(F.to_json(F.struct(*[rows[c] for c in fields]), {"ignoreNullFields": "false"}), 256)
    old = before.select("id", content(before).alias("_old"))
    return now.join(old, "id", "left").withColumn("reused", F.coalesce(content(now) == F.col("_old"), F.lit(False))).drop("_old")


def success_signature(states: DataFrame) -> DataFrame:
    """One row: source=time of the last success of all sources, in order; it changes when one succeeds again."""
    pair = F.concat_ws("=", "source", F.coalesce(F.col("last_success").cast("string"), F.lit("")))
    return states.agg(F.array_join(F.array_sort(F.collect_list(pair)), "|").alias("signature"))


def counters(outcomes: DataFrame) -> DataFrame:
    """outcomes (source, outcome, rows, complete) -> source, n, rows, pending, failed, fallback, complete, status.

    outcome: ok, fallback, pending or failed. status: error where all that was tried failed, partial where something is
    missing, else ok.
    """
    n_of = lambda *x: F.count(F.when(F.col("outcome").isin(*x), 1))
    n, failed = n_of("ok", "fallback"), n_of("failed")
    full = F.count(F.when(F.col("outcome").isin("ok", "fallback") & F.col("complete"), 1))
    status = F.when((failed > 0) & (n == 0), "error").when((failed > 0) | (n_of("pending", "fallback") > 0) | (full < n), "partial").otherwise("ok")
    return outcomes.groupBy("source").agg(
        n.alias("n"), F.coalesce(F.sum(F.when(F.col("outcome").isin("ok", "fallback"), F.col("rows"))), F.lit(0)).alias("rows"), n_of("pending").alias("pending"), failed.alias("failed"),
        n_of("fallback").alias("fallback"), full.alias("complete"), status.alias("status"),
    )


def reprocess_targets(notices: DataFrame, today: date, ids: list | None = None, sales_only: bool = False, active: bool = False, limit: int | None = 50) -> DataFrame:
    """Notices (id, category, official_url, announcement_date, events) whose documents are read again, the latest announced first.

    limit: 1 to TARGETS rows, or None for all.
    """
    rows = notices.filter(F.col("official_url").isNotNull())
    rows = rows if ids is None else rows.filter(F.col("id").isin(ids))
    rows = rows.filter(F.col("category").isin(*SALES)) if sales_only else rows
    day = F.lit(today)
    open_now = lambda e: is_application(e["kind"]) & (is_open_ended(e["kind"], e["label"], e["end_date"]) | (F.coalesce(e["end_date"], e["start_date"]) >= day))
    rows = rows.filter(F.exists("events", open_now)) if active else rows
    rows = rows.orderBy(F.col("announcement_date").desc_nulls_last(), "id")
    return rows if limit is None else rows.limit(max(1, min(limit, TARGETS)))


def by_day(notices: DataFrame) -> DataFrame:
    """Notices (id, title, day) as a row for each day: n, ids in order of title and id, position of the day from 1."""
    listed = F.sort_array(F.collect_list(F.struct("title", "id")))
    groups = notices.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.transform(listed, lambda x: x["id"]).alias("ids"))
    return groups.withColumn("position", F.dense_rank().over(Window.orderBy("day")).cast("long"))  # a row for each day
