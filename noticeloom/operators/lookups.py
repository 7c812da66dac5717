"""Lookups in small tables that a rule brings along: tiers, bands, tables with extrapolation, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(area: Column, tiers: list[tuple[float | None, object]]) -> Column:
    """The value of the first tier, in order, whose limit is null or at least the area."""
    out = F.lit(None)
    for limit, value in reversed(tiers):
        hit = F.lit(True) if limit is None else F.lit(limit) >= area
        out = F.when(area.isNotNull() & hit, value).otherwise(out)
    return out


def band(value: Column, bands: list[tuple[float, float | None, object]]) -> Column:
    """The result of the band with low < value <= high (null: open), else null. Bands must not overlap."""
    out = None
    for low, high, result in bands:
        hit = (value > low) if high is None else (value > low) & (value <= high)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out


def sized(size: Column, table: dict[int, int], extra: int | None = None) -> Column:
    """A table by household size: sizes below take the smallest entry, sizes above the largest and extra for each more."""
    least, most = min(table), max(table)
    known = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    inside = F.element_at(known, F.least(F.greatest(size, F.lit(least)), F.lit(most)))
    above = F.lit(None) if extra is None else F.lit(table[most]) + (size - most) * extra
    return F.when(size > most, above).otherwise(inside)


def in_scope(own: Column, parent: Column, scope: Column) -> Column:
    """Whether a region is the scope or lies in it; null where either is unknown."""
    return (own == scope) | F.coalesce(parent == scope, F.lit(False))


def scope_keys(rows: DataFrame, own: Column, parent: Column) -> DataFrame:
    """rows, once for each scope that they are in by in_scope (their own region, and its parent), as `scope`: an equi-join finds the scopes."""
    keys = F.array_distinct(F.array_compact(F.array(own, parent)))
    return rows.withColumn("scope", F.explode(keys))


# Regions of the deposit table's columns; all other provinces are of the last.
DEPOSIT_REGIONS = {"seoul_busan": ("11", "26"), "other_metropolitan": ("27", "28", "29", "30", "31"), "other": ("36", "41", "43", "44", "46", "47", "48", "50", "51", "52")}


def deposit_required(areas: Column, region: Column, tiers: dict[str, list[tuple[float | None, int]]]) -> Column:
    """The deposit that a notice asks of someone of a region: of the region's column, the first tier that takes each area (array of
    exclusive areas). Null where an area or the region isn't known, or where the areas ask for different amounts."""
    out = F.lit(None).cast("long")
    for name, codes in DEPOSIT_REGIONS.items():
        asked = F.array_distinct(F.transform(areas, _tier_of(tiers[name])))
        own = F.when((F.size(asked) == 1) & ~F.exists(areas, lambda a: a.isNull()), F.get(asked, F.lit(0)))
        out = F.when(region.isin(*codes), own).otherwise(out)
    return out


def _tier_of(tiers: list[tuple[float | None, int]]):
    return lambda a: tier(a, tiers).cast("long")
