"""Tables whose lines are lost: labels stand one after the other, then their values, and pair by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.dates import date_token, end_token

DAY = r"20\d{2}[.\-/년]\s*\d{1,2}[.\-/월]\s*\d{1,2}일?"
PERIOD = rf"{DAY}\.?(?:\s*\([^)]{{1,3}}\))?(?:\s*[~∼]\s*(?:20\d{{2}}[.\-/년]\s*)?\d{{1,2}}[.\-/월]\s*\d{{1,2}}일?\.?(?:\s*\([^)]{{1,3}}\))?)?"


def paired(text: Column, labels: dict[str, str], value: str) -> Column:
    """map<label, value> of a flattened table: the labels in the order in which they stand, each with the value of its place.

    labels: names and their patterns; those that the text lacks are no columns. value: the pattern of a value; those
    behind the last label count. Null without labels, or with fewer values than labels.
    """
    def of(t: Column) -> Column:
        at = F.array(*[F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), F.lit(name).alias("name")) for name, p in labels.items()])
        return once(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), lambda places: pairs(t, places))

    def pairs(t: Column, places: Column) -> Column:
        values = F.regexp_extract_all(F.substr(t, F.element_at(places, -1)["at"]), F.lit(f"({value})"), F.lit(1))
        names = F.transform(places, lambda x: x["name"])
        whole = lambda v: F.when(F.size(v) >= F.size(places), F.map_from_arrays(names, F.slice(v, 1, F.size(places))))
        return F.when(F.size(places) > 0, once(values, whole))

    return once(text, of)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often `of` names it."""
    return F.transform(F.array(value), of)[0]


def period(text: Column) -> Column:
    """struct<start, end> of a day or of two with a tilde; the end may leave the year out. Null if they are out of order."""
    def of(parts: Column) -> Column:
        return once(date_token(parts[0]), lambda start: until(parts, start))

    def until(parts: Column, start: Column) -> Column:
        end = F.when(F.size(parts) == 1, start).otherwise(end_token(F.get(parts, F.lit(1)), start))
        return once(end, lambda e: F.when(start <= e, F.struct(start.alias("start"), e.alias("end"))))

    return once(F.split(F.regexp_replace(text, r"\([^)]*\)", ""), r"[~∼]"), of)


def agreed_value(values: Column) -> Column:
    """The one value that an array has, nulls left out; null if it has several or none."""
    own = F.array_distinct(F.array_compact(values))
    return F.when(F.size(own) == 1, F.get(own, F.lit(0)))
