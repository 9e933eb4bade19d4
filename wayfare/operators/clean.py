"""Trip-sheet cleaning (D8-D26) and the four row-level EPKM definitions.

EPKM (earnings per km) exists in four row-level variants that the three
trip dashboards define differently; all are kept under their own names:

* ``epkm_zero_guard``  (B): amount / distance; x/0, NaN and NULL -> 0; rounded to 2
* ``epkm_epsilon``     (C): amount / (distance + 1e-9); NaN/NULL -> 0; rounded to 2
                         (distance 0 gives amount * 1e9, *not* 0)
* ``epkm_null_guard``  (D): distance 0 -> NULL, then amount / distance, NULL -> 0;
                         unrounded
* ``revenue_per_km``   (A, tickets): amount / (km, 0 -> 1); see ``enrich``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import (day_name, hms_to_hours, key_to_text, month_name, round_half_even_binary,
                         safe_div, to_double, to_long)
from ..functions.numeric import col
from ..sources.quality import observe_coerced

EPSILON = 1e-9  # fixed value: distance offset of the epsilon EPKM variant


def epkm_zero_guard(amount="total_amount", distance="travel_distance") -> Column:
    """EPKM-B: amount / distance; x/0, NaN, NULL -> 0; rounded to 2 places."""
    return round_half_even_binary(F.coalesce(safe_div(col(amount), col(distance)), F.lit(0.0)), 2)


def epkm_epsilon(amount="total_amount", distance="travel_distance") -> Column:
    """EPKM-C: amount / (distance + 1e-9); NaN, NULL -> 0; rounded to 2 places."""
    d = col(distance) + F.lit(EPSILON)
    return round_half_even_binary(F.coalesce(safe_div(col(amount), d), F.lit(0.0)), 2)


def epkm_null_guard(amount="total_amount", distance="travel_distance") -> Column:
    """EPKM-D: distance 0 -> NULL, amount / distance, NULL -> 0; unrounded."""
    return F.coalesce(safe_div(col(amount), F.nullif(col(distance), F.lit(0.0))), F.lit(0.0))


def _running_date() -> Column:
    return F.col("running_date").cast("string").try_cast("timestamp_ntz")


def coerce_running_date(df: DataFrame) -> DataFrame:
    """Parse ``running_date`` leniently (bad text -> NULL) and drop NULLs.

    The result is a naive wall-clock TIMESTAMP_NTZ, so nothing depends on
    the session time zone."""
    return df.withColumn("running_date", _running_date()).where(F.col("running_date").isNotNull())


def _observe(df: DataFrame, counts: Observation | None, numbers: list[str], required: list[str]) -> DataFrame:
    """Raw rows with counters of D8 / D12 (``observe_coerced``): values that the
    cleaning turns into NULL, and ``dropped_rows`` that it drops because the date
    or a ``required`` number is missing or bad."""
    if counts is None:
        return df
    numbers = [c for c in numbers if c in df.columns]
    pairs = {"running_date": (F.col("running_date"), _running_date())}
    pairs |= {c: (F.col(c), to_double(c)) for c in numbers}
    dropped = _running_date().isNull()
    for c in required:
        if c in numbers:
            dropped = dropped | to_double(c).isNull()
    return observe_coerced(df, counts, pairs, dropped_rows=dropped)


def add_calendar_names(df: DataFrame, date_col: str = "running_date") -> DataFrame:
    """English month and day names."""
    return (df.withColumn("month", month_name(F.col(date_col)))
              .withColumn("day_of_week", day_name(F.col(date_col))))


def default_missing_columns(df: DataFrame, columns=("total_amount", "travel_distance",
                                                     "trip_number", "total_count")) -> DataFrame:
    """Add each listed column that is absent as a constant 0."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df


def clean_trips_basic(df: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Trip cleaning of the daily dashboard (EPKM variant B).

    Invalid dates are dropped; ``service_type`` aliases ``color_line``; the
    amount, distance and trip number are coerced to numbers; missing
    passenger counts become 0; rows whose amount, distance or trip number is
    missing are dropped.  ``counts`` observes what is coerced and dropped.
    """
    df = _observe(df, counts, ["total_amount", "travel_distance", "trip_number", "total_count"],
                  ["total_amount", "travel_distance", "trip_number"])
    df = coerce_running_date(df)
    df = add_calendar_names(df)
    df = df.withColumn("service_type", F.col("color_line"))
    df = (df.withColumn("total_amount", to_double("total_amount"))
            .withColumn("travel_distance", to_double("travel_distance"))
            .withColumn("trip_number", to_double("trip_number")))
    df = df.withColumn("Epkm", epkm_zero_guard())
    df = df.withColumn("total_count", F.coalesce(to_double("total_count"), F.lit(0.0)))
    return df.dropna(subset=["total_amount", "travel_distance", "trip_number", "Epkm", "total_count"])


def clean_trips_extended(df: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Trip cleaning of the drill-down dashboard (EPKM variant C).

    As ``clean_trips_basic`` but: absent numeric columns default to 0;
    ``running_time`` is coerced to a number (``H:MM:SS`` text is not a number
    and becomes NULL); passenger count and trip number become whole numbers
    with missing -> 0, so rows with a bad trip number survive; only a missing
    amount or distance drops a row.  ``counts`` observes what is coerced and
    dropped.
    """
    df = _observe(df, counts, ["total_amount", "travel_distance", "trip_number", "total_count", "running_time"],
                  ["total_amount", "travel_distance"])
    df = coerce_running_date(df)
    df = add_calendar_names(df)
    df = df.withColumn("service_type", F.col("color_line"))
    df = default_missing_columns(df)
    for c in ("total_amount", "travel_distance"):
        df = df.withColumn(c, to_double(c))
    if "running_time" in df.columns:
        df = df.withColumn("running_time", to_double("running_time"))
    df = df.withColumn("Epkm", epkm_epsilon())
    df = (df.withColumn("total_count", F.coalesce(to_long("total_count"), F.lit(0)).cast("long"))
            .withColumn("trip_number", F.coalesce(to_long("trip_number"), F.lit(0)).cast("long")))
    return df.dropna(subset=["total_amount", "travel_distance", "Epkm", "total_count", "trip_number"])


def running_time_hours(df: DataFrame, column: str = "running_time") -> DataFrame:
    """``H:MM:SS`` text -> fractional hours."""
    return df.withColumn(column, hms_to_hours(F.col(column)))


def clean_trips_monthly(df: DataFrame) -> DataFrame:
    """Trip cleaning of the month-comparison dashboard (EPKM variant D).

    Dates are parsed strictly (a malformed date fails the query); running
    time becomes hours; keys are stringified with NULL -> 'nan'; a zero
    distance becomes NULL; nothing is dropped.
    """
    df = df.withColumn("running_date", F.to_date(F.col("running_date").cast("string")))
    df = running_time_hours(df)
    for c in ("color_line", "route_no", "schedule_number"):
        df = df.withColumn(c, key_to_text(F.col(c)))
    df = df.withColumn("travel_distance", F.nullif(F.col("travel_distance"), F.lit(0.0)))
    df = df.withColumn("Epkm", epkm_null_guard())
    return add_calendar_names(df)
