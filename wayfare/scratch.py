"""Tables that a job writes below the shared folder, and their removal.

``keep_table`` cuts lineage: a table is written as Parquet below
``spark.checkpoint.dir`` and read back.  ``drop_table`` removes one as soon as
nothing reads it any more; ``scratch_scope`` removes, when its block ends, what
was written inside, so that a long session does not fill the shared folder::

    with scratch_scope(spark):
        stats.service_epkm_stats(trips).write.parquet(target)

A result that is used after the block must be written (or collected) inside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import scratch_path

# paths written inside the open scopes, innermost last
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed with the open scope."""
    path = scratch_path(spark, name, uuid.uuid4().hex)
    if _open:
        _open[-1].append(path)
    return path


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back."""
    return keep_at(df, name)[0]


def keep_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``keep_table`` and the table's path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that ``path`` lies on, and the path as its type."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of whatever file system it lies on."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes on exit what ``keep_table`` and ``new_path`` gave inside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_path(spark, path)
