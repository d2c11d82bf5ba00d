"""Shared working storage: the folder the cluster names in ``spark.checkpoint.dir``.

Working tables go when ``discard`` is called, the rest when the session's JVM ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where materialised tables lie, by identity of their frame.
_PATHS: dict[int, str] = {}
#: Spark's own switch that removes the shuffle files of an execution once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session (tests) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="stratafold-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _shuffles_end_with_it(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: its result is in a table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all it holds, where there is one."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a folder."""
    files, target = _file_system(spark, path)
    return files.getContentSummary(target).getLength()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratafold/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_it(spark):
        df.write.parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)  # what nobody discards goes when the session's JVM ends
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = path
    weakref.finalize(table, _PATHS.pop, id(table), None)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more.

    Call it only when what was derived from the tables has been materialised itself.
    """
    for table in tables:
        if path := _PATHS.pop(id(table), None):
            delete(table.sparkSession, path)
