"""Committed exports: a failed run leaves the last one whole."""

import pytest
from pyspark.sql import functions as F

from wayfare.sources import export_csv, export_csv_with_count, export_manifest


def ids(spark, path):
    return sorted(r.id for r in spark.read.option("header", True).schema("id long").csv(path).collect())


def test_export_is_replaced_as_a_whole(spark, tmpdir_path):
    path, n = export_csv_with_count(spark.range(7), tmpdir_path, "rows")
    assert n == 7 and ids(spark, path) == list(range(7))
    m = export_manifest(spark, path)
    assert m["rows"] == 7 and m["columns"] == ["id"] and m["files"] and all(f["bytes"] > 0 for f in m["files"] if "part" in f["name"])
    path2, n = export_csv_with_count(spark.range(2), tmpdir_path, "rows")
    assert path2 == path and n == 2 and ids(spark, path) == [0, 1]
    assert export_manifest(spark, path)["rows"] == 2


def test_failed_export_keeps_the_last_one(spark, tmpdir_path):
    import os
    path = export_csv(spark.range(4), tmpdir_path, "rows", dated=False)
    bad = spark.range(100, 200, numPartitions=4).select(
        F.when(F.col("id") == 199, F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no more"):
        export_csv(bad, tmpdir_path, "rows", dated=False)
    assert ids(spark, path) == [0, 1, 2, 3] and export_manifest(spark, path)["rows"] == 4
    assert [f for f in os.listdir(tmpdir_path) if not f.startswith(".")] == ["filtered_rows"]
