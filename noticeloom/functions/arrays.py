"""Rows of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inlined(rows: DataFrame, keep: list[str | Column], array: str | Column) -> DataFrame:
    """keep and the fields of each struct of an array, as inline gives them; the array is computed once.

    Of inline Spark infers filters (the array is known and not empty) that compute it twice more, and below the exchange that dealt
    the rows to all cores.
    """
    out = rows.select(*keep, F.posexplode_outer(array).alias("_at", "_row")).filter("_at IS NOT NULL")
    return out.select(*[c for c in out.columns if c not in ("_at", "_row")], "_row.*")
