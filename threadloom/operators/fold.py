"""Order-sensitive folds of event streams: current turns, promotion, pairing and last-known values.

The functions over windows of whole groups fold groups of bounded size. ``segmented`` folds
groups of any size by the same rules: a group is cut into segments in its order, each segment
is reduced to what later and earlier ones need to know of it, these summaries are combined in
a small window over the group's segments, and what is carried is applied within each segment.
So the rows of one group are folded by many tasks, and only summaries meet in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _so_far(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _after(by: list[str], order: list[str]) -> WindowSpec:
    """The rows after each one: those before it in the reversed order."""
    return Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)


def running_turn(rows: DataFrame, starts: Column, by: list[str], order: list[str], name: str = "turn_no") -> DataFrame:
    """Number of turns begun so far: ``starts`` marks the rows that begin one."""
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(_so_far(by, order)).cast("long"))


def forward_fill(rows: DataFrame, marker: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """The last marker that is not null, up to and with each row."""
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(_so_far(by, order)))


def promote(rows: DataFrame, by: list[str], order: list[str], explicit: str, implicit: str, name: str, fresh: Column | None = None) -> DataFrame:
    """The turn that each marker row stands for; null for rows that are no markers.

    Markers have an ``explicit`` id or, where that is null, an ``implicit`` one. An implicit
    marker takes the explicit id of the next marker if the group has not seen that id before
    (and ``fresh`` holds there); otherwise it keeps its own.
    """
    seen = Window.partitionBy(*by, explicit).orderBy(*order)
    is_marker = F.col(explicit).isNotNull() | F.col(implicit).isNotNull()
    first = F.col(explicit).isNotNull() & (F.row_number().over(seen) == 1)
    rows = rows.withColumn("__mark", F.when(is_marker, F.struct(F.col(explicit).alias("id"), (first if fresh is None else first & fresh).alias("first"))))
    # The next marker is the last one so far of the reversed order.
    rows = rows.withColumn("__next", F.last("__mark", ignorenulls=True).over(_after(by, order)))
    taken = F.when(F.col("__next.first"), F.col("__next.id"))
    return rows.withColumn(name, F.coalesce(explicit, F.when(F.col(implicit).isNotNull(), F.coalesce(taken, implicit)))).drop("__mark", "__next")


def first_sights(rows: DataFrame, by: list[str], segment: str, order: list[str], value: str, name: str) -> DataFrame:
    """Whether a row is the first of its group with its ``value``; false where that is null.

    First places combine on the map side, and come back to one row each, so a value that very
    many rows have is no hot key.
    """
    place = F.min(F.struct(*order, segment)).alias("at")
    held = rows.where(F.col(value).isNotNull())
    firsts = held.groupBy(*by, value).agg(place).select(*by, *[F.col(f"at.{c}").alias(c) for c in (segment, *order)], F.lit(True).alias(name))
    found = held.join(firsts, [*by, segment, *order], "left").withColumn(name, F.coalesce(name, F.lit(False))).select(*rows.columns, name)
    # Rows without a value, mostly nearly all, are not moved.
    return found.unionByName(rows.where(F.col(value).isNull()).withColumn(name, F.lit(False)))


def segmented(rows: DataFrame, by: list[str], segment: str, order: list[str], claim: str, begins: str, takes: Column, own_id: Callable[[Column], Column], mark: str, current: str) -> DataFrame:
    """``running_turn``, ``promote`` and ``forward_fill`` in one, by segments.

    A row with a ``claim`` marks that turn; one that ``begins`` a turn without a claim takes
    the claim of the group's next marker if that one ``takes`` it, else it is called
    ``own_id`` of the number of such beginnings so far. ``mark`` is the turn that a row marks,
    ``current`` the last one marked up to and with each row.

    Of a segment it is enough to know its number of beginnings, its first marker, and whether
    its last marker has a claim.
    """
    keys = [*by, segment]
    at, starts = F.struct(*order), F.col(begins)
    own = F.struct(F.col(claim).alias("claim"), takes.alias("takes"))
    marker = F.when(F.col(claim).isNotNull() | starts, at)
    parts = rows.groupBy(*keys).agg(F.count_if(starts).alias("n"), F.min_by(own, marker).alias("first"), F.max_by(own, marker).alias("last"))
    parts = parts.withColumns({"before": F.coalesce(F.sum("n").over(_before(by, [segment])), F.lit(0)), "next": F.last("first", ignorenulls=True).over(_after(by, [segment]))})
    # A beginning without a claim that is a segment's last marker is the last of its beginnings.
    ends = F.when(F.col("last").isNotNull(), F.coalesce("last.claim", F.when(F.col("next.takes"), F.col("next.claim")), own_id(F.col("before") + F.col("n"))))
    parts = parts.withColumn("ends", ends).withColumn("carried", F.last("ends", ignorenulls=True).over(_before(by, [segment])))
    rows = rows.join(parts.select(*keys, "before", "next", "carried"), keys)

    is_marker = F.col(claim).isNotNull() | starts
    number = F.col("before") + F.sum(starts.cast("int")).over(_so_far(keys, order))
    following = F.coalesce(F.last(F.when(is_marker, own), ignorenulls=True).over(_after(keys, order)), F.col("next"))
    rows = rows.withColumns({"__number": number, "__next": following})
    rows = rows.withColumn(mark, F.coalesce(claim, F.when(starts, F.coalesce(F.when(F.col("__next.takes"), F.col("__next.claim")), own_id(F.col("__number"))))))
    return rows.withColumn(current, F.coalesce(F.last(mark, ignorenulls=True).over(_so_far(keys, order)), F.col("carried"))).drop("before", "next", "carried", "__number", "__next")


def _before(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _calls(by: list[str], order: list[str], marked: Column) -> WindowSpec:
    """Calls and outputs by their group; any other row is alone, so that rows without a call are no hot group."""
    return Window.partitionBy(*[F.when(marked, F.col(c)) for c in by], F.when(~marked, F.xxhash64(*order))).orderBy(*order)


def pair_calls(rows: DataFrame, by: list[str], order: list[str], call: Column, output: Column, carried: Column, name: str) -> DataFrame:
    """For each output row the ``carried`` value of the call just before it among the calls and outputs of its group.

    An output that follows another output has no call; a call that follows a call replaces it.
    """
    return rows.withColumn(name, F.when(output, F.lag(F.when(call, carried)).over(_calls(by, order, call | output))))


def pending_calls(rows: DataFrame, by: list[str], order: list[str], call: Column, output: Column, name: str) -> DataFrame:
    """Whether a row is the call that is still open at the end of its group: the last call or output, if that is a call."""
    return rows.withColumn(name, call & F.lead(F.lit(1)).over(_calls(by, order, call | output)).isNull())
