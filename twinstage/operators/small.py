"""Tables that several jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a table that several jobs re-read to ``spark.checkpoint.dir`` (shared
    storage): lineage is cut, the producing scan/join runs once, and a lost
    executor costs a re-read instead of a recomputation."""
    return df.checkpoint(eager=True)


def class_sized(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of one row a class (or class and bucket), written once. Up to ``most`` rows, by count, it is joined by
    broadcast: no row of the other side moves, so a hot class does not end in one task."""
    table = checkpointed(df)
    return F.broadcast(table) if table.count() <= most else table
