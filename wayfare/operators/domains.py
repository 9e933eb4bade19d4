"""Filter domains (U1-U8): distinct values and bounds.

``page_domains`` gives all lists and bounds of a page in one pass over its table;
the single ones below are for a page that shows one widget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import DAY_NAMES, day_number_of_name, iso_week


def distinct_values(df: DataFrame, column: str, sort: bool = False) -> DataFrame:
    """Distinct values of one column (NULL included as a value)."""
    out = df.select(column).distinct()
    return out.orderBy(F.asc_nulls_last(column)) if sort else out


def available_months(df: DataFrame, date_col: str = "running_date") -> DataFrame:
    """Month names present, with their calendar number for ordering."""
    return (df.select(F.month(date_col).cast("long").alias("month_no"),
                      F.date_format(date_col, "MMMM").alias("month"))
              .distinct().orderBy("month_no"))


def available_days(df: DataFrame, day_col: str = "day_of_week") -> DataFrame:
    """U4: day names present, Monday first."""
    present = df.select(F.col(day_col).alias("day_of_week")).distinct()
    present = present.where(F.col("day_of_week").isin(DAY_NAMES))
    return (present.withColumn("day_no", day_number_of_name(F.col("day_of_week")).cast("long"))
                   .orderBy("day_no"))


def weeks_in_month(df: DataFrame, month_no: int, date_col: str = "running_date") -> DataFrame:
    """ISO week numbers of rows whose date falls in calendar month
    ``month_no`` (any year)."""
    return (df.where(F.month(date_col) == F.lit(month_no))
              .select(iso_week(F.col(date_col)).alias("iso_week")).distinct().orderBy("iso_week"))


def ticket_bounds(df: DataFrame) -> DataFrame:
    """U6/U7 over tickets: first and last date, truncated max km."""
    return df.agg(F.to_date(F.min("ticket_datetime")).alias("min_date"),
                  F.to_date(F.max("ticket_datetime")).alias("max_date"),
                  F.floor(F.max("travelled_KM")).cast("long").alias("max_km_int"))


def trip_bounds(df: DataFrame, top_cap: int = 20) -> DataFrame:
    """U6-U8 over trips: date bounds, the trip-number slider maximum
    (truncated max, 10 when not positive) and the top-N cap
    ``min(top_cap, distinct routes)``."""
    mx = F.max("trip_number")
    return df.agg(
        F.to_date(F.min("running_date")).alias("min_date"),
        F.to_date(F.max("running_date")).alias("max_date"),
        F.when(mx > 0, F.floor(mx)).otherwise(F.lit(10)).cast("long").alias("max_trip_slider"),
        F.least(F.lit(top_cap), F.count_distinct("route_no")).cast("long").alias("top_n_cap"),
    )


def page_domains(df: DataFrame, columns: list[str], date_col: str, number: str) -> DataFrame:
    """U1-U8 in one fact read: the distinct values of every column in ``columns``
    (NULL is a value) as rows (``domain``, ``value``), each with its ``rows``,
    first and last date and greatest ``number``; the row with ``domain`` NULL is
    the whole table.  ``GROUPING SETS`` of one column each: partial aggregation
    leaves at most a row per value and task for the shuffle."""
    day = F.to_date(date_col)
    sets = [[c] for c in columns] + [[]]
    g = df.select(*columns, day.alias("_d"), F.col(number).alias("_n")).groupingSets(sets, *columns).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("rows"), F.min("_d").alias("first_date"),
        F.max("_d").alias("last_date"), F.max("_n").cast("double").alias("max_number"))
    full = (1 << len(columns)) - 1
    of = [full & ~(1 << (len(columns) - 1 - i)) for i in range(len(columns))]
    domain, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, i in zip(columns, of):
        domain = F.when(F.col("_id") == i, F.lit(c)).otherwise(domain)
        value = F.when(F.col("_id") == i, F.col(c).cast("string")).otherwise(value)
    return g.select(domain.alias("domain"), value.alias("value"), "rows", "first_date", "last_date", "max_number")
