"""Boards: which of their landed pages count, what a failed board costs its source, and which notice a marked title corrects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.text import base_title
from noticeloom.operators.history import asof_latest


def link_corrections(notices: DataFrame) -> DataFrame:
    """notices -> with correction_of_external_id of titles that begin with a correction mark: the latest earlier row of the same source,
    category and title without the mark. Rows of the same day are not earlier; equal days go to the greatest id."""
    rows = notices.withColumn("_base", base_title(F.col("title"))).withColumn("_marked", F.col("_base") != F.trim("title"))
    found = asof_latest(rows, rows.select("source", "category", "_base", "announcement_date", "external_id"), ["source", "category", "_base"], "announcement_date", "announcement_date", ["external_id"])
    value = F.when(F.col("_marked"), F.col("asof_external_id"))
    return found.withColumn("correction_of_external_id", F.coalesce(value, "correction_of_external_id")).drop("_base", "_marked", "asof_external_id")


def scanned(pages: DataFrame, first: date, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rows of the pages that count, an outcome for each board) of landed pages.

    pages (board, page from 1, failed, rows: array<struct<title, day, ...>>). In their order a board's pages count up to one
    that is empty or says the same as an earlier one (its titles), and including one that has a row of before `first`: what
    comes behind would be older. outcome: ok, or why the board can't be told whole: failed (a page before that end),
    empty (no first page with rows), limit (`most` pages and no end).
    """
    titles = F.sha2(F.to_json(F.transform("rows", lambda r: r["title"])), 256)
    none = F.coalesce(F.size("rows"), F.lit(0)) < 1
    rows = pages.filter(F.col("page") <= most).withColumns({"_none": none, "_same": titles, "_old": F.coalesce(F.array_min(F.transform("rows", lambda r: r["day"])) < F.lit(first), F.lit(False))})
    by_board = Window.partitionBy("board").orderBy("page")
    again = F.row_number().over(Window.partitionBy("board", "_same").orderBy("page")) > 1
    rows = rows.withColumn("_end", F.col("failed") | F.col("_none") | again)
    so_far, before = by_board.rowsBetween(Window.unboundedPreceding, 0), by_board.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_ended": F.max("_end").over(so_far), "_past": F.coalesce(F.max("_old").over(before), F.lit(False)), "_stopped": F.coalesce(F.max("_end").over(before), F.lit(False))})
    counts = ~F.col("_ended") & ~F.col("_past")
    reached = ~F.col("_stopped") & ~F.col("_past")  # the scan would have come to this page
    told = rows.groupBy("board").agg(
        F.bool_or(reached & F.col("failed")).alias("_failed"), F.bool_or((F.col("page") == 1) & ~F.col("failed") & ~F.col("_none")).alias("_first"),
        F.count(F.when(counts, 1)).alias("n_pages"), F.bool_or(reached & (F.col("_end") | F.col("_old"))).alias("_over"),
    )
    outcome = F.when(F.col("_failed"), "failed").when(~F.col("_first"), "empty").when(~F.col("_over") & (F.col("n_pages") == most), "limit").otherwise("ok")
    return rows.filter(counts).select("board", "page", F.inline("rows")), told.select("board", outcome.alias("outcome"), "n_pages")


def collected(rows: DataFrame, outcomes: DataFrame, boards: DataFrame, day: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of sources, a poll for each source) of scanned boards.

    boards (board, source, optional). A source whose board failed has no rows, unless that board is optional: then it has those
    of the others and is partial. Boards of which nothing landed have failed. day: which rows are of the window. A poll: source,
    status, message (the boards that failed and why), record_count (null on an error), at.
    """
    known = boards.join(outcomes, "board", "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    bad = F.col("outcome") != "ok"
    why = F.array_join(F.array_sort(F.collect_list(F.when(bad, F.concat_ws(":", "board", "outcome")))), ",")
    sources = known.groupBy("source").agg(F.bool_or(bad & ~F.col("optional")).alias("_error"), F.bool_or(bad).alias("_partial"), why.alias("message"))
    own = rows.filter(day).join(known.filter(~bad).select("board", "source"), "board").join(sources.filter("NOT _error").select("source"), "source", "left_semi")
    counted = own.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("_error"), "error").when(F.col("_partial"), "partial").otherwise("ok")
    count = F.when(~F.col("_error"), F.coalesce("_n", F.lit(0)))
    return own, sources.join(counted, "source", "left").select("source", status.alias("status"), F.nullif("message", F.lit("")).alias("message"), count.alias("record_count"), at.alias("at"))
