"""Statuses of sources: what a poll leaves of the last success, and sources of which a poll brought nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that a source may have, and those of a success.
STATUSES = ("ok", "partial", "error", "pending", "running", "disabled")
GOOD = ("ok", "partial")
STATE = "source string, status string, message string, last_attempt_at timestamp, last_success_at timestamp, record_count bigint"


def with_missing(polls: DataFrame, sources: list[str], at: Column) -> DataFrame:
    """polls (source, status, message, record_count, at) and an error for each source named of which there is none."""
    named = polls.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    gone = named.join(polls.select("source").distinct(), "source", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return polls.select("source", "status", "message", F.col("record_count").cast("long").alias("record_count"), "at").unionByName(
        gone.select("source", F.lit("error").alias("status"), F.lit("nothing landed").alias("message"), none("long").alias("record_count"), at.alias("at"))
    )


def counted(accepted: DataFrame, rejected: DataFrame, at: Column) -> DataFrame:
    """Polls of landed rows: a source's rows are counted, and it is partial where rows of it were rejected, an error where all were."""
    rows = accepted.select("source", F.lit(1).alias("good")).unionByName(rejected.select("source", F.lit(0).alias("good"))).filter(F.coalesce("source", F.lit("")) != "")
    n = rows.groupBy("source").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("good") == F.col("n"), "ok").when(F.col("good") > 0, "partial").otherwise("error")
    message = F.when(F.col("good") < F.col("n"), F.concat((F.col("n") - F.col("good")).cast("string"), F.lit(" rows rejected")))
    return n.select("source", status.alias("status"), message.alias("message"), F.when(F.col("good") > 0, F.col("good")).alias("record_count"), at.alias("at"))


def updated(states: DataFrame | None, polls: DataFrame) -> DataFrame:
    """Rows of STATE (None: none yet) after polls (source, status, message, record_count, at).

    The last poll of a source tells status, message and attempt; the last success and its count stay from before unless a
    poll succeeds, and a count that a poll doesn't tell stays too. Polls without a source or with a status that isn't known don't count. One join on the source.
    """
    good = F.col("status").isin(*GOOD)
    known = polls.filter((F.coalesce("source", F.lit("")) != "") & F.col("status").isin(*STATUSES))
    order = F.struct("at", "status", "message", "record_count")
    last = known.groupBy("source").agg(
        F.max_by(F.struct("status", "message", "at"), order).alias("p"), F.max(F.when(good, F.col("at"))).alias("succeeded"),
        F.max_by("record_count", F.when(F.col("record_count").isNotNull(), order)).alias("counted"),
    )
    if states is None:
        states = polls.sparkSession.createDataFrame([], STATE)
    rows = states.join(last, "source", "full_outer")
    told = lambda new, old: F.when(F.col("p").isNotNull(), F.col(f"p.{new}")).otherwise(F.col(old))
    return rows.select(
        "source", told("status", "status").alias("status"), told("message", "message").alias("message"), F.greatest(F.col("p.at"), F.col("last_attempt_at")).alias("last_attempt_at"),
        F.greatest("succeeded", "last_success_at").alias("last_success_at"), F.coalesce("counted", "record_count").alias("record_count"),
    )
