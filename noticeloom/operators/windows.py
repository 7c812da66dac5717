"""Notices and their application events in a window of dates: filters, derived dates, pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.session import ensure_checkpoint_dir

# Kinds of events that aren't applications, and wordings of a reception without an end.
OTHER_KINDS = ("announcement", "contract", "result", "winner")
OPEN_ENDED = r"(?U)상시|마감\s*시|소진\s*시|종료일\s*미공개"
NOT_OPEN = r"당첨자 발표|계약일|계약 체결"


def is_application(kind: Column) -> Column:
    """Lists and dates of notices know kinds as they are written: `Contract` isn't `contract`, and counts as an application."""
    return ~kind.isin(*OTHER_KINDS)


def of_any_case(kind: Column) -> Column:
    """Receptions of a screen and open ends are told whatever the case of the kind."""
    return ~F.lower(kind).isin(*OTHER_KINDS)


def is_open_ended(kind: Column, label: Column, end: Column) -> Column:
    """No end, and a label that says so; without such a label a missing end means a single day."""
    words = F.coalesce(label, F.lit(""))
    return end.isNull() & of_any_case(kind) & words.rlike(OPEN_ENDED) & ~words.rlike(NOT_OPEN)


def overlaps(start: Column, end: Column, open_ended: Column, first: date, last: date) -> Column:
    return (start <= F.lit(last)) & (open_ended | (F.coalesce(end, start) >= F.lit(first)))


def application_summary(events: DataFrame, first: date | None, last: date | None) -> DataFrame:
    """events (notice_id, kind, label, start_date, end_date) -> one row for each notice with an application event.

    n_applications, hits (that overlap the window), first_start, last_end (null where one has no end),
    first_hit: the earliest day in the window on which one that ends runs, open_from: the start of an open one.
    """
    rows = events.filter(is_application(F.col("kind"))).withColumn("open", is_open_ended(F.col("kind"), F.col("label"), F.col("end_date")))
    hit = F.lit(True) if first is None or last is None else overlaps(F.col("start_date"), F.col("end_date"), F.col("open"), first, last)
    from_day = F.col("start_date") if first is None else F.greatest("start_date", F.lit(first))
    return rows.groupBy("notice_id").agg(
        F.count(F.lit(1)).alias("n_applications"),
        F.count(F.when(hit, 1)).alias("hits"),
        F.min("start_date").alias("first_start"),
        F.when(F.max("open"), F.lit(None).cast("date")).otherwise(F.max(F.coalesce("end_date", "start_date"))).alias("last_end"),
        F.min(F.when(hit & ~F.col("open"), from_day)).alias("first_hit"),
        F.min(F.when(F.col("open"), F.col("start_date"))).alias("open_from"),
    )


def in_window(notices: DataFrame, events: DataFrame, first: date | None, last: date | None, application_only: bool = False) -> DataFrame:
    """Notices (id, announcement_date, ...) in the window, with sort_date and application_end_date.

    A notice is in the window if an application event overlaps it, or, unless application_only, if it has no such
    event and was announced in it. One shuffle of events by notice; the join needs no second one.
    """
    if first is not None and last is not None and last < first:
        raise ValueError("the window ends before it begins")
    found = application_summary(events, first, last)
    rows = notices.join(found, notices["id"] == found["notice_id"], "left").drop("notice_id")
    if first is not None and last is not None:
        fallback = F.col("n_applications").isNull() & F.col("announcement_date").between(F.lit(first), F.lit(last))
        hit = F.coalesce(F.col("hits") > 0, F.lit(False))
        rows = rows.filter(hit if application_only else hit | fallback)
    elif application_only:
        rows = rows.filter("n_applications > 0")
    opened = F.col("open_from") <= F.lit(last) if last is not None else F.col("open_from").isNotNull()
    sort_date = F.coalesce("first_hit", F.when(~F.coalesce(opened, F.lit(False)), F.coalesce("first_start", "announcement_date")))
    return rows.withColumn("sort_date", sort_date).withColumnRenamed("last_end", "application_end_date").drop("hits", "first_hit", "open_from", "first_start")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page by the order, each row with the total before paging. The list is written to the checkpoint folder once, then counted and cut."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(rows.count()).cast("long"))


def density(events: DataFrame, first: date, last: date, unavailable: Column) -> DataFrame:
    """events (start_date, end_date) -> day, n, all_unavailable, for days from first to last that an event covers."""
    begin, end = F.greatest("start_date", F.lit(first)), F.least(F.coalesce("end_date", "start_date"), F.lit(last))
    rows = events.withColumn("_begin", begin).withColumn("_end", end).filter("_begin <= _end").withColumn("_no", unavailable)
    rows = rows.select(F.explode(F.sequence("_begin", "_end")).alias("day"), "_no")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.bool_and("_no").alias("all_unavailable"))
