"""Calendar bins with empty bins kept.

A resample emits every bin between the first and the last bin that holds
data: sums of empty bins are 0, means are NULL.  The gaps are filled from the
per-bin aggregate itself (``lead`` + ``sequence`` + ``explode``); its size is the
number of calendar bins in the data's time span, not the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import month_end, null_safe_sum, week_ending_monday

FREQS = ("D", "W-MON", "M")


def bin_label(c: Column, freq: str) -> Column:
    """Label of the bin holding date/timestamp ``c``."""
    if freq == "D":
        return F.to_date(c)
    if freq == "W-MON":
        return week_ending_monday(c)
    if freq == "M":
        return month_end(c)
    raise ValueError(f"unsupported frequency {freq!r}; use one of {FREQS}")


def _step(freq: str) -> Column:
    return {"D": F.expr("interval 1 day"), "W-MON": F.expr("interval 7 days"),
            "M": F.expr("interval 1 month")}[freq]


def fill_bins(per_bin: DataFrame, label: str, freq: str, zero=()) -> DataFrame:
    """``per_bin`` (one row per bin that holds data) with the empty bins between
    its first and its last: ``zero`` measures 0, the others NULL.

    Every bin is followed by the bins up to the next one, so the grouping runs
    once; the window runs over bins, whose number the time span bounds."""
    after = F.lead(label).over(Window.orderBy(label))
    if freq == "M":
        # step over month starts, then label by month end
        here = F.trunc(label, "month")
        last = F.coalesce(F.add_months(F.trunc(after, "month"), -1), here)
        bins = F.transform(F.sequence(here, last, _step(freq)), F.last_day)
    else:
        days = 1 if freq == "D" else 7
        bins = F.sequence(F.col(label), F.coalesce(F.date_sub(after, days), F.col(label)), _step(freq))
    out = per_bin.withColumn("_bins", bins).withColumn("_bin", F.explode("_bins"))
    own = F.col("_bin") == F.col(label)
    cols = [F.when(own, F.col(c)).otherwise(F.lit(0) if c in zero else F.lit(None)).alias(c)
            for c in per_bin.columns if c != label]
    return out.select(F.col("_bin").alias(label), *cols).orderBy(label)


def resample(df: DataFrame, ts_col: str, freq: str, sums=(), means=(), counts=(),
             label: str = "period") -> DataFrame:
    """Aggregate per calendar bin, keeping empty bins, in calendar order.

    ``sums``: (out, column) pairs -> 0 for empty bins; ``means``: (out, column)
    pairs -> NULL; ``counts``: (out, column) pairs (non-NULL count) -> 0.
    """
    binned = df.where(F.col(ts_col).isNotNull()).withColumn(label, bin_label(F.col(ts_col), freq))
    aggs = ([null_safe_sum(c).alias(o) for o, c in sums] + [F.avg(c).alias(o) for o, c in means]
            + [F.count(c).alias(o) for o, c in counts])
    return fill_bins(binned.groupBy(label).agg(*aggs), label, freq, [o for o, _ in [*sums, *counts]])


def reindex(agg: DataFrame, key: str, categories: list, fill=None, order_col: str | None = None) -> DataFrame:
    """Left join from a literal category spine (``reindex(list)``).

    Categories without a row get NULL measures, or ``fill`` when given.
    ``order_col`` adds the category's position (1-based) for ordering.
    """
    spark = agg.sparkSession
    rows = [(c, i + 1) for i, c in enumerate(categories)]
    spine = spark.createDataFrame(rows, f"{key} string, _pos long")
    # The aggregate side is small but its size is only known at run time:
    # AQE turns this join into a broadcast join once the aggregate stage has
    # materialised and its size is measured.
    out = spine.join(agg, key, "left")
    if fill is not None:
        measures = [c for c in agg.columns if c != key]
        out = out.fillna(fill, subset=measures)
    if order_col:
        out = out.withColumnRenamed("_pos", order_col)
    else:
        out = out.drop("_pos")
    return out
