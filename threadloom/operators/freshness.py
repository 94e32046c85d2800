"""Which threads changed since they were indexed, and what an incremental refresh leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
#: Items of one segment of a thread: places that are equal but for so many low bits.
SEGMENT_BITS = 7


def _hashed(columns: list[str]) -> Column:
    """The SHA-256 of an item."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each thread's segments joined by line ends; a thread's rows follow one another, over batches as well."""
    thread = digest = None
    rows = lambda done: pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["thread_id", "content_fingerprint"])
    for batch in batches:
        done = []
        for name, hashes in zip(batch.column("thread_id").to_pylist(), batch.column("hashes")):
            if digest is None or name != thread:
                if digest is not None:
                    done.append((thread, digest.hexdigest()))
                thread, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(hashes.as_buffer())
        yield rows(done)
    if digest is not None:
        yield rows([(thread, digest.hexdigest())])


def digests(items: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """``thread_id, content_fingerprint``: the SHA-256 of the SHA-256 hashes of the thread's items, in order of ``place``, each on a line.

    Items that share a place are in order of their hashes, those without one come last. Items
    are hashed and brought into order by segments of places, so a thread of any length is dealt
    to many tasks; only its joined segments meet in one, which takes them one after another.
    """
    rows = items.select("thread_id", F.col(place).alias("__place"), F.shiftright(place, SEGMENT_BITS).alias("__segment"), _hashed(columns).alias("__hash"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__place", "__hash"))), lambda x: x["__hash"])
    parts = rows.groupBy("thread_id", "__segment").agg(F.array_join(listed, "\n").alias("hashes"))
    parts = parts.repartition("thread_id").sortWithinPartitions("thread_id", F.asc_nulls_last("__segment"))
    return parts.select("thread_id", "hashes").mapInArrow(_chained, "thread_id string, content_fingerprint string")


def fingerprints(items: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``thread_id, content_fingerprint``: four sums, modulo 2^64, of the parts of the SHA-256 of each item with its place.

    Sums combine on the map side, so a thread of any length is no array and no single task, and
    the print of a thread is that of its parts added up. An item's place is part of what is
    hashed, so items in another order have another print.
    """
    rows = items.select("thread_id", _hashed([*order, *columns]).alias("__hash"))
    # A part is below 2^64 and a sum of as many as there can be items below 10^38.
    parts = [F.sum(F.conv(F.substring("__hash", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    added = [(x.cast("decimal(38,0)") % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string") for x in parts]
    return rows.groupBy("thread_id").agg(F.concat_ws("-", *added).alias("content_fingerprint"))


def classify(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """``thread_id, content_fingerprint, freshness`` (new, changed or unchanged) of the current threads."""
    known = manifest.select("thread_id", F.col("content_fingerprint").alias("__known"))
    state = F.when(F.col("__known").isNull(), "new").when(F.col("__known") != F.col("content_fingerprint"), "changed").otherwise("unchanged")
    return current.join(known, "thread_id", "left").withColumn("freshness", state).drop("__known")


def refreshed(old: DataFrame, current: DataFrame, classes: DataFrame, prune: bool = False) -> DataFrame:
    """Rows of an index table after a refresh: new and changed threads from ``current``, all else from ``old``.

    Threads that no longer exist stay, unless ``prune``.
    """
    stale = classes.where("freshness <> 'unchanged'").select("thread_id")
    kept = old.join(stale, "thread_id", "left_anti")
    if prune:
        kept = kept.join(classes.select("thread_id"), "thread_id", "left_semi")
    return kept.unionByName(current.join(stale, "thread_id", "left_semi"))
