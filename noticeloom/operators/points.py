"""Points of an applicant: homeless years, dependants, account; 32 + 35 + 17 at most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.dates import full_months


def homeless_points(since: Column, day: Column, owner: Column) -> Column:
    """Two for each year begun, 32 at most; owners have 0; 0 where the time has not begun; null where unknown."""
    years = F.floor(full_months(since, day) / 12)
    return F.when(owner, 0).when(owner.isNotNull(), F.when(since > day, 0).otherwise(F.least(F.lit(32), (years + 1) * 2))).cast("int")


def dependant_points(count: Column) -> Column:
    """Five for each and five more, 35 at most."""
    return F.least(F.lit(35), (count + 1) * 5).cast("int")


def account_points(months: Column) -> Column:
    """1 below six months, 2 below twelve, then a point a year, 17 at most."""
    return F.when(months < 6, 1).when(months < 12, 2).when(months.isNotNull(), F.least(F.lit(17), F.floor(months / 12) + 2)).cast("int")


def totals(*parts: Column) -> tuple[Column, Column]:
    """The total, null unless every part is known, and the sum of the known parts."""
    total, confirmed = parts[0], F.coalesce(parts[0], F.lit(0))
    for part in parts[1:]:
        total, confirmed = total + part, confirmed + F.coalesce(part, F.lit(0))
    return total, confirmed
