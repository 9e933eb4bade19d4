"""Counts of malformed and coerced values, filled by the scan that does the work.

A lenient read or cleaning turns bad text into NULL.  Passed an ``Observation``,
it counts what it turned: the counters are aggregated in the tasks that read the
rows and are there when the first action on the result has run, so no second
read happens::

    seen = Observation("tickets")
    t = read_tickets(spark, path, counts=seen)
    t.write.parquet(target)
    seen.get["bad_px_count"], seen.get["torn_lines"]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observe_coerced(df: DataFrame, counts: Observation | None, coerced: dict[str, tuple[Column, Column]],
                    **more: Column) -> DataFrame:
    """``df`` with counters: ``rows``, per name ``bad_<name>`` (rows whose value
    is present before and NULL after) and one per condition in ``more``."""
    if counts is None:
        return df
    bad = [F.count_if(before.isNotNull() & after.isNull()).alias(f"bad_{name}") for name, (before, after) in coerced.items()]
    return df.observe(counts, F.count(F.lit(1)).alias("rows"), *bad, *[F.count_if(c).alias(n) for n, c in more.items()])
