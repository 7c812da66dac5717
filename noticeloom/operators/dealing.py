"""Rows dealt to tasks by number, where what a task groups or sorts would grow with its share of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, *keys: str, each: int = ROWS_A_TASK, of: DataFrame | None = None) -> DataFrame:
    """rows dealt by keys to tasks of about `each` rows; what is then grouped by the keys, and more, stays in its task.

    of: what the rows were made from, a row for each key or so, counted in their place where making them takes long.

    Without it a task first groups all that it reads of a file, which grows with the table, and a key that hardly repeats
    makes nothing smaller there. Counting reads no column that the count doesn't need.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-(rows if of is None else of).count() // each)), *keys)
