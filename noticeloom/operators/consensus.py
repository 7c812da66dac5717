"""Aggregates over official rows that may contradict each other, and ordered first- or best-row choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreed(value: Column, official: Column | None = None) -> Column:
    """Aggregate: the single distinct value that isn't null, else null."""
    own = value if official is None else F.when(official, value)
    return F.when(F.min(own) == F.max(own), F.min(own))


def conflicting(value: Column, official: Column | None = None) -> Column:
    """Aggregate: whether two distinct values occur."""
    own = value if official is None else F.when(official, value)
    return F.coalesce(F.min(own) != F.max(own), F.lit(False))


def preferring(df: DataFrame, keys: list[str], preferred: Column, value: Column, name: str) -> DataFrame:
    """keys -> the agreed value of the preferred rows where a key has any, else of all its rows."""
    has = F.max(F.coalesce(preferred, F.lit(False)))
    return df.groupBy(*keys).agg(F.when(has, agreed(value, preferred)).otherwise(agreed(value)).alias(name), has.alias("preferred"))


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order, which must decide ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def distinct_ordered(df: DataFrame, keys: list[str], columns: list[str], *order: Column) -> DataFrame:
    """The first of rows that are equal in columns within keys."""
    return best_row(df, [*keys, *columns], *order)


def same_sets(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same values; null where one is null."""
    return F.sort_array(F.array_distinct(left)) == F.sort_array(F.array_distinct(right))


def covers(present: Column, required: Column) -> Column:
    """Whether an array holds every required value; null where one is null."""
    return F.size(F.array_except(required, present)) == 0


def common(left: Column, right: Column) -> Column:
    """The values that two arrays share, in order."""
    return F.array_sort(F.array_intersect(left, right))


def all_of(value: Column) -> Column:
    """Aggregate, Kleene and: false beats unknown, unknown beats true; over no rows unknown."""
    return F.when(F.max(F.when(~value, 1)) == 1, False).when(F.count(F.when(value.isNull(), 1)) > 0, F.lit(None).cast("boolean")).when(F.count(F.lit(1)) > 0, True)


def any_of(value: Column) -> Column:
    """Aggregate, Kleene or: true beats unknown, unknown beats false; over no rows unknown."""
    return F.when(F.max(F.when(value, 1)) == 1, True).when(F.count(F.when(value.isNull(), 1)) > 0, F.lit(None).cast("boolean")).when(F.count(F.lit(1)) > 0, False)


def status_of(value: Column) -> Column:
    """Aggregate: mismatch, review, possible of pass/fail/review judgements; unpublished over none."""
    return (
        F.when(F.count(F.when(value == "fail", 1)) > 0, "mismatch").when(F.count(F.when(value == "review", 1)) > 0, "review")
        .when(F.count(value) > 0, "possible").otherwise("unpublished")
    )


def notice_status(value: Column) -> Column:
    """Aggregate of combinations' statuses: any possible; all mismatch; all unpublished; else review."""
    n = F.count(value)
    return (
        F.when(F.count(F.when(value == "possible", 1)) > 0, "possible").when((n > 0) & (F.count(F.when(value == "mismatch", 1)) == n), "mismatch")
        .when((n > 0) & (F.count(F.when(value == "unpublished", 1)) == n), "unpublished").otherwise("review")
    )
