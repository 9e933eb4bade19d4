"""Composable row predicates.

Every builder returns a ``Column`` (or applies it), so filters compose with
``&`` and reach the scan as pushed-down predicates where they touch raw
columns.  An empty or ``None`` selection list means *no filter* unless a
function says otherwise.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso_week


def _as_ts(v) -> Column:
    """A date / datetime / ISO text bound as a TIMESTAMP_NTZ literal
    (a date-only bound means midnight)."""
    if isinstance(v, Column):
        return v.cast("timestamp_ntz")
    if isinstance(v, _dt.datetime):
        return F.lit(v).cast("timestamp_ntz")
    if isinstance(v, _dt.date):
        return F.lit(v.isoformat()).cast("timestamp_ntz")
    return F.lit(str(v)).cast("timestamp_ntz")


def _as_date(v) -> Column:
    if isinstance(v, Column):
        return F.to_date(v)
    if isinstance(v, (_dt.date, _dt.datetime)):
        return F.lit(v.isoformat()[:10]).cast("date")
    return F.lit(str(v)).cast("date")


def all_of(preds) -> Column:
    """Conjunction starting from TRUE."""
    return reduce(lambda a, b: a & b, [p for p in preds if p is not None], F.lit(True))


def optional_isin(c, values) -> Column | None:
    """``c IN values`` or ``None`` (no predicate) for an empty selection."""
    if not values:
        return None
    c = F.col(c) if isinstance(c, str) else c
    return c.isin(list(values))


def datetime_between(c, start, end) -> Column:
    """inclusive timestamp range; a date bound is midnight, so rows later
    than 00:00 on the end date are excluded."""
    c = F.col(c) if isinstance(c, str) else c
    return c.between(_as_ts(start), _as_ts(end))


def date_between(c, start, end) -> Column:
    """inclusive *date* range: the whole end day is kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c).between(_as_date(start), _as_date(end))


def default_date_range(df: DataFrame, ts_col: str = "ticket_datetime"):
    """The dashboard's default range: (date of min, date of max), as two
    scalar-subquery columns (computed once, no join)."""
    b = df.agg(F.struct(F.to_date(F.min(ts_col)).alias("d0"),
                        F.to_date(F.max(ts_col)).alias("d1")).alias("b"))
    s = b.select("b").scalar()
    return s.getField("d0"), s.getField("d1")


def filter_global(df: DataFrame, date_range=None, services=None,
                  ts_col: str = "ticket_datetime") -> DataFrame:
    """ticket date range (F1 semantics) AND optional service list.

    Without an explicit range the default (first date .. last date, end at
    midnight) is applied, as the ticket dashboard always does.
    """
    if date_range is None:
        date_range = default_date_range(df, ts_col)
    pred = all_of([datetime_between(ts_col, date_range[0], date_range[1]),
                   optional_isin("service_type", services),
                   month_partition_predicate(df, date_range[0], date_range[1])])
    return df.where(pred)


def month_partition_predicate(df: DataFrame, start, end, part: str = "ticket_month") -> Column | None:
    """Redundant ``yyyy-MM`` range on the month partition column of a
    materialised table (see ``plans.inputs``), so a date-range filter prunes
    partitions; ``None`` when the table has no such column."""
    if part not in df.columns:
        return None
    return F.col(part).between(F.date_format(_as_date(start), "yyyy-MM"),
                               F.date_format(_as_date(end), "yyyy-MM"))


def filter_summary(df: DataFrame, ticket_types=None, routes=None) -> DataFrame:
    """optional ticket-type and route lists."""
    return df.where(all_of([optional_isin("ticket_type", ticket_types),
                            optional_isin("route_no", routes)]))


def filter_route(df: DataFrame, route, column: str = "route_no") -> DataFrame:
    """single-route equality."""
    return df.where(F.col(column) == F.lit(route))


def max_whole_km(df: DataFrame, column: str = "travelled_KM") -> Column:
    """``int(max(km))`` (truncated) as a scalar-subquery column."""
    return df.agg(F.floor(F.max(column)).cast("long").alias("m")).select("m").scalar()


def filter_route_distance(df: DataFrame, route: str = "All", min_km=0, max_km=None,
                          column: str = "travelled_KM") -> DataFrame:
    """route or "All", then ``min_km <= km <= max_km``.

    The default upper bound is the truncated maximum, so rows whose km lies
    above the whole part of a fractional maximum drop out.
    """
    if max_km is None:
        max_km = max_whole_km(df, column)
    if route != "All":
        df = df.where(F.col("route_no") == F.lit(route))
    hi = max_km if isinstance(max_km, Column) else F.lit(max_km)
    return df.where((F.col(column) >= F.lit(min_km)) & (F.col(column) <= hi))


def filter_vehicle_dates(df: DataFrame, vehicle: str = "All", start=None, end=None,
                         ts_col: str = "ticket_datetime") -> DataFrame:
    """Vehicle or "All" AND inclusive date-level range (defaults: the
    first and last date of the data, which every dated row is in)."""
    if start is None and end is None:
        df = df.where(F.col(ts_col).isNotNull())
        return df if vehicle == "All" else df.where(F.col("vehicle_no") == F.lit(vehicle))
    if vehicle != "All":
        df = df.where(F.col("vehicle_no") == F.lit(vehicle))
    if start is None or end is None:
        d0, d1 = default_date_range(df, ts_col)
        start = d0 if start is None else start
        end = d1 if end is None else end
    return df.where(all_of([date_between(ts_col, start, end),
                            month_partition_predicate(df, start, end)]))


@dataclass
class CalendarFilter:
    """The trip dashboards' selection lists.

    ``weeks`` (ISO weeks) only apply when exactly one month is selected; an
    empty ``weeks`` list then also means no filter.
    """

    months: list = field(default_factory=list)
    weeks: list = field(default_factory=list)
    days: list = field(default_factory=list)
    services: list = field(default_factory=list)
    routes: list = field(default_factory=list)

    def predicate(self, date_col: str = "running_date") -> Column:
        week = (optional_isin(iso_week(F.col(date_col)), self.weeks)
                if len(self.months) == 1 else None)
        return all_of([optional_isin("month", self.months), week,
                       optional_isin("day_of_week", self.days),
                       optional_isin("service_type", self.services),
                       optional_isin("route_no", self.routes)])

    def apply(self, df: DataFrame, date_col: str = "running_date") -> DataFrame:
        return df.where(self.predicate(date_col))


@dataclass
class MonthlyDashboardFilter:
    """date range AND four optional lists over the month sheet.

    A one-element range selects that single day; the default range is the
    whole data (no predicate).
    """

    date_range: tuple | None = None
    services: list = field(default_factory=list)
    routes: list = field(default_factory=list)
    days: list = field(default_factory=list)
    months: list = field(default_factory=list)

    def predicate(self) -> Column:
        rng = None
        if self.date_range:
            start = self.date_range[0]
            end = self.date_range[0] if len(self.date_range) == 1 else self.date_range[1]
            rng = F.col("running_date").between(_as_date(start), _as_date(end))
        return all_of([rng, optional_isin("color_line", self.services),
                       optional_isin("route_no", self.routes),
                       optional_isin("day_of_week", self.days),
                       optional_isin("month", self.months)])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())


def cascade_route_schedule(df: DataFrame, routes, schedules=None) -> DataFrame:
    """route selection, then schedule selection within it.

    Unlike the other lists an empty route (or schedule) selection yields an
    *empty* result.  ``schedules=None`` keeps every schedule of the routes.
    """
    if not routes:
        return df.limit(0)
    out = df.where(F.col("route_no").isin(list(routes)))
    if schedules is not None:
        if not schedules:
            return df.limit(0)
        out = out.where(F.col("schedule_number").isin(list(schedules)))
    return out
