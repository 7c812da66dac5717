"""Date functions. 'Today' is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_months(start: Column, end: Column) -> Column:
    """Whole months from start to end, by anniversaries clamped to the month's end; null where start is after end."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(start <= end, months - F.when(end < F.add_months(start, months), 1).otherwise(0))


def age_at(birth: Column, day: Column) -> Column:
    """Full years by month and day: a birthday on 29 February comes on 1 March in common years; null before birth."""
    passed = (F.month(day) > F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) >= F.dayofmonth(birth)))
    return F.when(birth <= day, F.year(day) - F.year(birth) - F.when(passed, 0).otherwise(1))


def strict_date(text: Column) -> Column:
    """yyyy-mm-dd and a day of the calendar, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def lenient_date(text: Column) -> Column:
    """Dates of feeds: 8 digits, or parts by '.', '/' or '-', what follows a T or a space cut off; else null."""
    day = F.regexp_replace(F.element_at(F.split(F.trim(text), r"[T\s]", 2), 1), r"[./]", "-")
    day = F.regexp_replace(day, "-$", "")
    parts = F.when(day.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    long = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day)
    return F.coalesce(parts, long).try_cast("date")


def short_year_date(text: Column) -> Column:
    """yy.mm.dd of this century, else null."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{2})\.(\d{1,2})\.(\d{1,2})\.?\s*$", i)
    return F.when(part(1) != "", F.concat(F.lit("20"), part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0")).try_cast("date"))


def korean_dates(text: Column) -> Column:
    """Every 20yy년 m월 d일 of a text as an array of dates, in order; impossible days are left out."""
    found = F.regexp_extract_all(text, F.lit(r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"), F.lit(0))
    part = lambda x, i: F.lpad(F.regexp_extract(x, r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", i), 2, "0")
    days = F.transform(found, lambda x: F.concat_ws("-", part_year(x), part(x, 2), part(x, 3)).try_cast("date"))
    return F.filter(days, lambda d: d.isNotNull())


def part_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(20\d{2})\s*년", 1)


def contract_day(basis: Column, start: Column, end: Column, verification: Column, today: Column) -> Column:
    """The day on which a contract-date condition is judged: fixed, ongoing or a range, of official schedules only."""
    fixed = F.when((basis == "fixed") & (F.coalesce(end, start) == start), start)
    ongoing = F.when((basis == "ongoing") & (start <= today) & F.coalesce(today <= end, F.lit(True)), today)
    ranged = F.when(basis == "range", F.when(today < start, start).when(today <= end, today))
    return F.when(verification == "official", F.coalesce(fixed, ongoing, ranged))


def recognised_months(start: Column, birth: Column, day: Column) -> Column:
    """Account months that count: of those before the age of 19 the last five years, before 2024 the last two.

    Null where the dates are out of order. The part that counts is one interval, so no month is cut in two.
    """
    adult = F.add_months(birth, 12 * 19)
    minor_end = F.least(adult, day)
    old_end = F.least(minor_end, F.lit("2024-01-01").cast("date"))
    begin = F.when(start >= adult, start).otherwise(F.greatest(start, F.add_months(old_end, -24), F.add_months(minor_end, -60)))
    return F.when((birth <= start) & (start <= day) & (birth <= day), full_months(begin, day))


def birthday(birth: Column, years: int) -> Column:
    """The day on which someone turns `years`; 29 February comes on the 28th in common years."""
    return F.add_months(birth, 12 * years)


def rolling_range(today: Column, days: int = 90) -> Column:
    """struct<first, last>: the last `days` days, today included."""
    return F.struct(F.date_sub(today, days - 1).alias("first"), today.alias("last"))


def seoul_timestamp(text: Column) -> Column:
    """An instant of an ISO text: with Z or an offset as told, else the time of day in Seoul; null where it is none."""
    plain = F.trim(text)
    zoned = plain.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, plain.try_cast("timestamp")).otherwise(F.to_utc_timestamp(plain.try_cast("timestamp_ntz").cast("timestamp"), "Asia/Seoul"))


def seoul_day(instant: Column) -> Column:
    """struct<day, seconds_left>: the day in Seoul at an instant of a UTC session, and the seconds until the next begins."""
    there = F.from_utc_timestamp(instant, "Asia/Seoul")
    return F.struct(there.cast("date").alias("day"), (86_400 - (F.hour(there) * 3600 + F.minute(there) * 60 + F.second(there))).cast("long").alias("seconds_left"))


def date_token(text: Column) -> Column:
    """The day of three numbers in a text, whatever stands between them; years of two digits are of this century. Else null."""
    n = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    year = F.when(F.length(n[0]) <= 2, F.concat(F.lit("20"), F.lpad(n[0], 2, "0"))).otherwise(n[0])
    whole = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(n[1], 2, "0"), F.lpad(n[2], 2, "0"))
    return F.when((F.size(n) == 3) & (F.length(year) <= 4), whole.try_cast("date"))


def end_token(text: Column, start: Column) -> Column:
    """The end of a period: a whole date_token, or month and day in the year of the start."""
    n = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    partly = F.concat_ws("-", F.year(start).cast("string"), F.lpad(n[0], 2, "0"), F.lpad(n[1], 2, "0")).try_cast("date")
    return F.when(F.size(n) == 3, date_token(text)).when(F.size(n) == 2, partly)


def criterion_day(
    basis: Column, specified: Column, contract: Column, original: Column, method: Column, method_day: Column, announced: Column, today: Column,
) -> Column:
    """The day on which a rule is judged.

    Application-date rules: today. Else the day that the rule names (a text; null where it is no day); contract-date rules:
    the contract's day; rules of the original announcement: that day; other bases than the announcement: none. Notices
    that aren't ranked: their method's day, else the announcement; ranked ones: the original announcement, else this one.
    """
    plain = F.coalesce(basis, F.lit("announcement"))
    unranked = F.coalesce(~method.isin("apt_ranked", "unknown"), F.lit(False))
    return (
        F.when(plain == "application_date", today).when(specified.isNotNull(), strict_date(specified)).when(plain == "contract_date", contract)
        .when(plain == "original_announcement", original).when(~plain.isin("announcement", "announcement_date"), None)
        .when(unranked, F.coalesce(method_day, announced)).otherwise(F.coalesce(original, announced))
    )
