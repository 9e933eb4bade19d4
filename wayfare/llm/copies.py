"""Rows that occur several times: numbering the copies of equal rows.

Operators that decide by row number or by copy work on a light table of row
keys (a 64-bit hash of all columns) and bring the decision back to the whole
rows.  Equal rows are counted with partial aggregation before they are
shuffled, so a row that makes up a third of a table is one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import col, free_name


def row_key(df: DataFrame):
    """Hash of all columns of a row."""
    return F.xxhash64(*[col(c) for c in df.columns])


def with_copy_number(df: DataFrame, own: list[str], key: str, count: str, number: str) -> DataFrame:
    """``df`` plus ``number``: 0 .. n-1 over the n rows that share ``key``.

    ``count`` is n; ``own`` are the rows' columns, all others depend on ``key``.
    Which of several equal rows gets which number makes no difference; rows
    that only share the hash are ordered by their columns."""
    rest = [c for c in df.columns if c not in own and c != key]
    single = df.where(F.col(count) == 1).withColumn(number, F.lit(0).cast("long"))
    c, upto = free_name(df, "_c"), free_name(df, "_upto")
    many = (df.where(F.col(count) > 1).groupBy(*[col(x) for x in own], key, *rest).agg(F.count(F.lit(1)).alias(c)))
    order = Window.partitionBy(key).orderBy(*[col(x).asc_nulls_first() for x in own])
    many = many.withColumn(upto, F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    many = many.withColumn(number, F.explode(F.sequence(F.col(upto) - F.col(c), F.col(upto) - 1)))
    return single.unionByName(many.drop(c, upto))
