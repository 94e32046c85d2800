"""Keeping an index up to date from a file stream of logs; an extension, run when called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.engine import Engine
from threadloom.storage import released


def refresh_available(spark: SparkSession, path: str, checkpoint: str, engine: Callable[[], Engine]) -> int:
    """Refresh the index once for all log files that arrived since the last call; returns how many batches did.

    The stream's checkpoint remembers which files were seen; the refresh itself tells which
    ones changed and parses these.
    """
    done = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal done
        if not rows.isEmpty():
            own = engine()
            with released(spark):
                (own.refresh_index if own.index.meta() else own.build_index)()
            done += 1

    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    stream = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return done
