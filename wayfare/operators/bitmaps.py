"""Exact distinct counts by bitmaps over whole-number ids.

An id's bucket holds 32,768 neighbouring ids, one bit each.  Grouping by bucket
gives a bitmap of 4 kB per bucket that partial aggregation builds in every task
and that merges by OR, so distinct ids and any sums come out of one pass over the
rows, without an Expand.  That suits ids that are dense, as running numbers are: a
bitmap then stands for thousands of ids.  Where ids are far apart each would cost
4 kB, so there a plain grouping by id is used instead (``dense=False``); both are
exact.  NULL ids are not counted, but their rows' sums are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bitmaps(df: DataFrame, ident: str, by: list[str] = (), also: dict[str, Column] | None = None) -> DataFrame:
    """One row per ``by`` group and bucket of ids: ``bucket`` (NULL for rows
    without id), ``ids`` (bitmap) and the aggregates ``also``."""
    i = F.col(ident).cast("long")
    bit = F.bitmap_bit_position(F.coalesce(i, F.lit(0)))
    return (df.groupBy(*by, F.bitmap_bucket_number(i).alias("bucket"))
            .agg(F.bitmap_construct_agg(bit).alias("ids"), *[e.alias(n) for n, e in (also or {}).items()]))


def merge_bitmaps(parts: DataFrame, by: list[str] = (), also: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``id_bitmaps`` (of several batches or finer groups) as one row per
    ``by`` group and bucket."""
    return parts.groupBy(*by, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"),
                                            *[e.alias(n) for n, e in (also or {}).items()])


def bits() -> Column:
    """Distinct ids of rows of ``id_bitmaps`` with one row per bucket, as an
    aggregate; the bucket of rows without id does not count."""
    return F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("ids"))), F.lit(0)).cast("long")


def count_ids(df: DataFrame, ident: str, sums: dict[str, Column], dense: bool = True) -> DataFrame:
    """One row: ``distinct_ids`` of ``ident`` and the sums (0 if there is nothing
    to add up; ``sums`` maps names to columns)."""
    total = {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in sums.items()}
    if dense:
        parts, distinct = id_bitmaps(df, ident, also=total), bits()
    else:
        parts = df.groupBy(F.col(ident).alias("bucket")).agg(*[e.alias(n) for n, e in total.items()])
        distinct = F.count("bucket")
    return parts.agg(distinct.alias("distinct_ids"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])
