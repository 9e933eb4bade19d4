"""Join building blocks: last-wins dedupe and lookups.

The dashboards map codes through Python dicts.  Here each dict becomes a
de-duplicated dimension DataFrame joined with a left equi-join.  No side is
forced to broadcast: Catalyst broadcasts a side whose size statistics (bytes)
are below ``spark.sql.autoBroadcastJoinThreshold``, and AQE switches to a
broadcast join at run time once a de-duplicated dimension's real size is known;
beyond the threshold the join is a sort-merge join with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_last(dim: DataFrame, keys: list[str], values: list[str], order_col: str = "ord") -> DataFrame:
    """One row per key: the values of the row with the greatest ``order_col``.

    This is dict semantics (a later duplicate overwrites an earlier one).  It
    is a hash aggregate with map-side partial aggregation, so a key holding a
    large share of the rows is pre-reduced in every task before the shuffle.
    Values are wrapped in a struct so that a NULL value of the winning row is
    kept rather than skipped.
    """
    picked = dim.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order_col)).alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def _unique(dim: DataFrame, keys: list[str], value: str, order_col: str) -> DataFrame:
    return dedupe_last(dim, keys, [value], order_col) if order_col in dim.columns else dim.select(*keys, value)


def lookup(df: DataFrame, dim: DataFrame, left_key: str, dim_key: str, value: str,
           out: str, order_col: str = "ord") -> DataFrame:
    """Left lookup ``df.left_key -> dim.value`` as column ``out``.

    Unmatched codes give NULL; duplicate codes resolve to the last dim row.  A
    dimension without ``order_col`` is taken as de-duplicated before.
    """
    d = _unique(dim, [dim_key], value, order_col).select(
        F.col(dim_key).alias("_lk"), F.col(value).alias(out))
    return df.join(d, df[left_key] == d["_lk"], "left").drop("_lk")


def lookup_with_fallback(df: DataFrame, dim: DataFrame, keys: list[str], value: str,
                         target: str, order_col: str = "ord") -> DataFrame:
    """Overwrite ``target`` with ``dim.value`` where the composite key matches.

    A matched key whose value is NULL yields NULL (the key is present); only
    an absent key keeps the row's own value.  A dimension without ``order_col`` is
    taken as de-duplicated before.
    """
    d = (_unique(dim, keys, value, order_col)
         .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                 F.col(value).alias("_val"), F.lit(True).alias("_matched")))
    cond = [df[k] == d[f"_k{i}"] for i, k in enumerate(keys)]
    j = df.join(d, cond, "left")
    j = j.withColumn(target, F.when(F.col("_matched"), F.col("_val")).otherwise(F.col(target)))
    return j.drop("_val", "_matched", *[f"_k{i}" for i in range(len(keys))])
