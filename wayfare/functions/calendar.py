"""Calendar expressions: names, ISO weeks, bucket labels, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# English day names in calendar order (Monday first).
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
             "Saturday", "Sunday"]


def month_name(d) -> Column:
    return F.date_format(col(d), "MMMM")


def day_name(d) -> Column:
    return F.date_format(col(d), "EEEE")


def month_number_of_name(name) -> Column:
    """Calendar number (1-12) of an English month name; NULL otherwise."""
    return F.month(F.try_to_timestamp(F.concat(F.lit("2000 "), col(name)), F.lit("yyyy MMMM")))


def day_number_of_name(name) -> Column:
    """Monday = 1 .. Sunday = 7 for an English day name."""
    arr = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.array_position(arr, col(name)).cast("int")


def iso_week(d) -> Column:
    return F.weekofyear(col(d)).cast("long")


def week_ending_monday(d) -> Column:
    """Label of a Tuesday..Monday week: the Monday on or after the date."""
    return F.next_day(F.date_sub(F.to_date(col(d)), 1), "Mon")


def month_end(d) -> Column:
    return F.last_day(F.to_date(col(d)))


def month_start(d) -> Column:
    return F.trunc(F.to_date(col(d)), "month")


def hms_to_hours(s) -> Column:
    """Duration text -> fractional hours: ``H:MM:SS`` (hours may exceed 24), with
    an optional day part as in ``1 days 02:00:00``.  NULL stays NULL; text that
    is no duration fails the query, as the strict parser of the month sheet does.
    """
    t = F.trim(col(s))
    form = r"^(?:([0-9]+) days?,? )?([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?)$"
    part = lambda i: F.regexp_extract(t, form, i)
    days = F.coalesce(part(1).try_cast("double"), F.lit(0.0))
    hours = (days * F.lit(24.0) + part(2).cast("double") + part(3).cast("double") / F.lit(60.0)
             + part(4).cast("double") / F.lit(3600.0))
    bad = F.raise_error(F.concat(F.lit("not a duration: "), t)).cast("double")
    return F.when(t.isNull(), F.lit(None)).when(t.rlike(form), hours).otherwise(bad)
