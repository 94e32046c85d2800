"""Merging the shards of a thread: summaries, turns, commands and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresher(rows: DataFrame, by: list[str], seq: str, updated: Column | str, created: Column | str, name: str = "is_record") -> DataFrame:
    """Mark the shards that count as fresher than all before them, taken in the order of ``seq``.

    A shard's freshness is its update time, else its creation time; the merged record so far
    has the latest update, else the earliest creation. Equal shards count as fresher; nulls are
    the oldest.
    """
    before = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    updated, created = (F.col(c) if isinstance(c, str) else c for c in (updated, created))
    low = F.lit(-(2**62))
    fresh = F.coalesce(updated, created, low)
    old = F.coalesce(F.max(updated).over(before), F.min(created).over(before), low)
    tie = F.coalesce(created, low) >= F.coalesce(F.min(created).over(before), low)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(seq)) == 1
    return rows.withColumn(name, first | (fresh > old) | ((fresh == old) & tie))


def preferred(value: str, seq: str, record: str = "is_record") -> Column:
    """Of a group's values the last one from a fresher shard, else the first there is."""
    held = F.col(value).isNotNull()
    return F.coalesce(F.max_by(value, F.when(F.col(record) & held, F.col(seq))), F.min_by(value, F.when(held, F.col(seq))))


def first_known(value: str, seq: str) -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))


def back_fill(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with nulls of ``name`` filled from ``names`` (``key``, ``name``), one row for each key."""
    known = names.select(key, F.col(name).alias("__name"))
    return rows.join(known, key, "left").withColumn(name, F.coalesce(name, "__name")).drop("__name")
