"""Joins of rows to a table with one row per key, where keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
BROADCAST_BYTES = 8 << 20


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], salt) -> DataFrame:
    """Left join; the rows of a key are dealt over ``SALTS`` tasks by a hash of
    the column ``salt``, the table's rows are copied to each."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "_salt"], "left").drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], salt, size) -> DataFrame:
    """Left join to a written table: broadcast if its measured size (sum of the
    column ``size``, in bytes) is at most ``BROADCAST_BYTES``, salted beyond."""
    if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, "left")
    return salted_join(rows, table, on, salt)
