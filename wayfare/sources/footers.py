"""Bounds of a stored table from its Parquet footers.

Least and greatest values of whole-number, floating and date columns are in the
footers of Parquet files.  The V2 source takes an aggregate of them alone from
there (``PushedAggregation`` in the plan), so the date range and the sliders of a
page cost one footer read per file and no row.  Timestamps have no usable
statistics: store the date beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# settings of the reading session only
_CONF = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_bounds_frame(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: ``min_<column>`` and ``max_<column>`` of each column."""
    reader = spark.newSession()
    for k, v in _CONF.items():
        reader.conf.set(k, v)
    return reader.read.parquet(path).agg(*[f(c).alias(f"{n}_{c}") for c in columns
                                           for n, f in (("min", F.min), ("max", F.max))])


def footer_bounds(spark: SparkSession, path: str, columns: list[str]) -> Row:
    """The row of ``footer_bounds_frame``, for literals of a filter."""
    return footer_bounds_frame(spark, path, columns).first()
