"""Tables written in the folder that all executors share, to cut lineage and long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For each open ``released`` the folders staged inside.
_inside: list[list[str]] = []
#: Whether Spark deletes a query's shuffle files when the query ends, and not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set on a single machine, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside to their end leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, outlives: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    What was computed survives lost executors, and later steps plan and read only the table;
    the shuffle files of the write are deleted with its end. One that ``outlives`` so many of
    the innermost open ``released`` belongs to the block around these, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    open_blocks = _inside[: max(0, len(_inside) - outlives)]
    if open_blocks:
        open_blocks[-1].append(path)
    with unshuffled(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are staged inside once the block ends; frames that read them end with it."""
    _inside.append([])
    try:
        yield
    finally:
        for path in _inside.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
