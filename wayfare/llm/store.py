"""Shared scratch of a job: reliable checkpoints and written tables.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only
where that setting is unset and the master is local (tests) a folder of the
machine is made; on a cluster an unset folder is an error, because executors
could not see each other's files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wayfare-llm-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: cuts
    lineage, survives lost executors and is read with pruned columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    return written(df, "checkpoint")
