"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str, most: int = 250_000, rows_of: DataFrame | None = None) -> DataFrame:
    """Rows dealt by their keys to partitions of about ``most`` rows, at least as many as a shuffle has. A row group of a file
    is read by one task, in which costly expressions would run otherwise; and what a task holds doesn't grow with the table. ``rows_of``: a table with as many rows, to count instead."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-(rows if rows_of is None else rows_of).count() // most)), *keys)
