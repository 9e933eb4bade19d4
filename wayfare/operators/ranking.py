"""Top-k and ordering with the dashboards' tie rules.

``nlargest`` / ``nsmallest`` keep, among equal values, the row whose key
sorts first, and put NULL values last.  ``orderBy(...).limit(n)`` plans as
TakeOrderedAndProject: each task keeps its own n best rows and only those
reach the final merge, so no full sort or single-task collection happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, value: str, keys, n: int, largest: bool = True) -> DataFrame:
    """The ``n`` rows with the largest (or smallest) ``value``, in that order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    first = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return df.orderBy(first, *[F.asc_nulls_last(k) for k in keys]).limit(n)


def sort_by(df: DataFrame, value: str, keys, descending: bool = True) -> DataFrame:
    """Full ordering by value then key (for small, already-aggregated results)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    first = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    return df.orderBy(first, *[F.asc_nulls_last(k) for k in keys])
