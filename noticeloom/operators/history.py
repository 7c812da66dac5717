"""Versions, latest rows, as-of values and retained successes over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(log: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """Rows of a log whose content differs from the key's row before, with content_hash and version from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = log.withColumn("content_hash", F.sha2(content, 256)).withColumn("_last", F.lag("content_hash").over(w))
    rows = rows.filter(~F.col("content_hash").eqNullSafe(F.col("_last"))).drop("_last")
    return rows.withColumn("version", F.row_number().over(w))


def latest(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: order is given as descending columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def retained(log: DataFrame, keys: list[str], order: list[str], value: Column, held: Column, name: str) -> DataFrame:
    """Each row with the last value so far of a row where held is true."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(name, F.last(F.when(held, value), ignorenulls=True).over(w))


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the key's right row that has the greatest time before its own, or nulls.

    Both sides go into one sorted run of each key, so a key is read once and no pairs are made. Of right rows with
    equal times the one with the greatest values counts.
    """
    named = F.struct(*[F.col(v) for v in values])
    none = F.lit(None).cast(right.select(named.alias("v")).schema["v"].dataType)
    both = left.select(F.struct(*left.columns).alias("_left"), *keys, F.col(left_time).alias("_time"), F.lit(0).alias("_side"), none.alias("_values"))
    both = both.unionByName(right.select(F.lit(None).cast(both.schema["_left"].dataType).alias("_left"), *keys, F.col(right_time).alias("_time"), F.lit(1).alias("_side"), named.alias("_values")))
    w = Window.partitionBy(*keys).orderBy("_time", "_side", "_values").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_found", F.last("_values", ignorenulls=True).over(w)).filter("_side = 0")
    return both.select("_left.*", *[F.col(f"_found.{v}").alias(f"asof_{v}") for v in values])


def fresh(status: Column, invalidated: Column, attempted: Column, succeeded: Column, now: Column, ttl: str = "6 hours", skew: str = "60 seconds") -> Column:
    """Whether a state may be relied on: ok or partial, not invalidated, no failure since, not old, not of the future."""
    age = (succeeded >= now - F.expr(f"INTERVAL {ttl}")) & (succeeded <= now + F.expr(f"INTERVAL {skew}"))
    return F.coalesce(status.isin("ok", "partial") & ~F.coalesce(invalidated, F.lit(False)) & (succeeded >= attempted) & age, F.lit(False))


def coverage(log: DataFrame, sources: list[str]) -> DataFrame:
    """log (source, status, attempted_at, record_count) -> a row for each source named, in order, then others by name.

    status and record_count are the last attempt's (a failure keeps the former count), last_success the last success.
    """
    good = F.col("status").isin("ok", "partial")
    state = log.groupBy("source").agg(
        F.max_by("status", F.struct("attempted_at", "status")).alias("status"), F.max("attempted_at").alias("last_attempt"),
        F.max(F.when(good, F.col("attempted_at"))).alias("last_success"), F.max_by("record_count", F.when(good, F.struct("attempted_at", "record_count"))).alias("record_count"),
    )
    known = log.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, position int")
    rows = known.join(state, "source", "full_outer")
    return rows.select("source", F.coalesce("status", F.lit("never")).alias("status"), "last_attempt", "last_success", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("position", F.lit(len(sources))).alias("position"))


def restricted(people: DataFrame, past: DataFrame, keys: list[str], day: str, past_day: str, months: int) -> DataFrame:
    """people with last (the latest past_day of past, or null) and passes: the day lies more than `months` months after it, or there is none."""
    last = past.groupBy(*keys).agg(F.max(past_day).alias("last"))
    return people.join(last, keys, "left").withColumn("passes", F.coalesce(F.col(day) > F.add_months("last", months), F.lit(True)))
