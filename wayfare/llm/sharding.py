"""Sharding: a Feistel permutation of global row numbers.

Every row gets a global number 0..N-1 in a fixed order (by a hash of the row's
columns, then the columns), computed without a global
sort: rows fall into ``BUCKETS`` hash ranges, a window numbers the rows of a
range, and the ranges' totals (at most ``BUCKETS`` rows, a documented bound)
give the offsets.  A keyed balanced Feistel network permutes the smallest
even-bit domain that holds N; cycle walking (apply again until the value is
below N) restricts it to 0..N-1.  With p the permuted number,
``shard = p % shards`` and ``slot = p // shards``: shard sizes differ by at
most one row, slots have no gaps, and both can be computed for any row number
(and inverted) without the data.

Only row keys are numbered; whole rows meet their number in one join.  Equal
rows are counted before the shuffle and expanded afterwards, so a row repeated
in a third of the table is one row while it is shuffled; which of the equal
rows gets which of their slots makes no difference.

NULLs and empty texts are ordinary values; an empty table gives an empty
result; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .copies import row_key, with_copy_number
from .names import col, free_name

BUCKETS = 1024
ROUNDS = 6
_GOLD = 0x9E3779B97F4A7C15


def _half_bits(n: int) -> int:
    bits = max(2, int(max(n, 1) - 1).bit_length())
    return (bits + 1) // 2


def _keys(seed: int) -> list[np.uint64]:
    out, x = [], (seed * _GOLD + 1) & (2 ** 64 - 1)
    for _ in range(ROUNDS):
        x = (x + _GOLD) & (2 ** 64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2 ** 64 - 1)
        out.append(np.uint64(z ^ (z >> 27)))
    return out


def _round(r: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (r + key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)) & mask


def _network(x: np.ndarray, half: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> h, x & mask
    if back:
        for k in reversed(keys):
            left, right = right ^ _round(left, k, mask), left
    else:
        for k in keys:
            left, right = right, left ^ _round(right, k, mask)
    return (left << h) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) applied to row numbers."""
    x = np.asarray(rows).astype(np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    half, keys = _half_bits(n), _keys(seed)
    x = _network(x, half, keys, back)
    out = x >= np.uint64(n)
    while out.any():                       # cycle walking; the domain is below 4 n
        x[out] = _network(x[out], half, keys, back)
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def shard_rows(df: DataFrame, shards: int, seed: int = 0,
               row: str = "row_number", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` plus its rows' global number, shard and slot (see the module).

    A result column whose name ``df`` already has gets underscores in front."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    own = list(df.columns)
    key, n, copy, base, total = (free_name(df, c) for c in ("_key", "_n", "_copy", "_base", "_total"))
    row, shard, slot, p = (free_name(df, c) for c in (row, shard, slot, "_p"))
    counted = (df.select(row_key(df).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias(n))
               .withColumn("_bucket", F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")))
    w = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    inside = counted.withColumn("_at", F.sum(n).over(w) - F.col(n))
    # at most BUCKETS rows from here to the broadcast
    sizes = counted.groupBy("_bucket").agg(F.sum(n).alias("_t"))
    offsets = sizes.select(
        "_bucket",
        (F.sum("_t").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_o"),
        F.sum("_t").over(Window.partitionBy(F.lit(0))).alias(total))
    starts = inside.join(F.broadcast(offsets), "_bucket").select(
        key, n, total, (F.col("_o") + F.col("_at")).alias(base))
    joined = df.withColumn(key, row_key(df)).join(starts, key)
    numbered = with_copy_number(joined, own, key, n, copy).withColumn(row, F.col(base) + F.col(copy))

    def apply(rows: pd.Series, totals: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), int(totals.iloc[0]) if len(totals) else 0, seed))

    place = F.pandas_udf(apply, "long")
    return (numbered.withColumn(p, place(F.col(row), F.col(total)))
            .select(*[col(c) for c in own], F.col(row), F.pmod(F.col(p), F.lit(shards)).cast("int").alias(shard),
                    F.expr(f"{p} div {shards}").cast("long").alias(slot)))
