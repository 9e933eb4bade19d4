"""Mergeable partial aggregates (S8): the dashboards' loaded table as a rollup.

The ticket and the trip dashboards filter by date, route, service and schedule
and then add up.  A rollup holds one row per (date, route, service, schedule) with
sums and counts; every filter on these keys (F2, F4, F5, F12-F16) applies to it as
it does to the facts, and the aggregates below are answered from it without the
facts.  Rows of one key may occur several times, since every reader adds up:
that makes batches mergeable.

``RollupStore`` keeps one on the shared file system, a folder per batch (say a
day's load).  ``append`` writes only the new batch, and writing a batch again
replaces it, so a load that failed half-way is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import DAY_NAMES, day_name, iso_week, month_name, month_number_of_name, month_start
from . import spine
from .ranking import sort_by, top_k
from .tickets import DIESEL, DIESEL_KG_CO2_PER_KM, EV

TICKET_KEYS = ("ticket_date", "at_midnight", "route_no", "service_type", "schedule_no")
TRIP_KEYS = ("running_date", "route_no", "service_type", "schedule_number")
TICKET_SUMS = ("px_count", "px_total_amount", "travelled_KM", "revenue_per_km", "passengers_per_km")
TRIP_SUMS = ("total_count", "total_amount", "travel_distance", "Epkm", "running_time")


def _partials(columns) -> list[Column]:
    return [e for c in columns for e in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]


def rollup_tickets(enriched: DataFrame) -> DataFrame:
    """Enriched tickets as a rollup.  ``at_midnight`` keeps the tickets of 00:00
    apart, which alone are inside a range that ends on their date (F1)."""
    df = enriched.withColumn("ticket_date", F.to_date("ticket_datetime")).withColumn(
        "at_midnight", F.col("ticket_datetime") == F.col("ticket_date").cast("timestamp_ntz"))
    return df.groupBy(*TICKET_KEYS).agg(F.count(F.lit(1)).alias("rows"), *_partials(TICKET_SUMS))


def rollup_trips(trips: DataFrame) -> DataFrame:
    """Cleaned trips as a rollup; ``trip_rows`` counts rows with a trip number and
    ``trip_max`` is the highest."""
    df = trips.withColumn("running_date", F.to_date("running_date"))
    if "running_time" not in df.columns:
        df = df.withColumn("running_time", F.lit(None).cast("double"))
    out = df.groupBy(*TRIP_KEYS).agg(F.count(F.lit(1)).alias("rows"), F.count("trip_number").alias("trip_rows"),
                                     F.max("trip_number").alias("trip_max"), *_partials(TRIP_SUMS))
    return with_calendar(out)


def with_calendar(rollup: DataFrame) -> DataFrame:
    """Month and day names, on which the trip filters (F12, F14) select."""
    return (rollup.withColumn("month", month_name(F.col("running_date")))
            .withColumn("day_of_week", day_name(F.col("running_date"))))


class RollupStore:
    """A rollup on the shared file system, one folder per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rollup: DataFrame, batch: str) -> None:
        """Add (or replace) one batch; no other batch is read or written."""
        (rollup.withColumn("batch", F.lit(batch)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")


# --------------------------------------------------------------- aggregates
def total(column: str) -> Column:
    """Sum over the facts (0 if there are none)."""
    return F.coalesce(F.sum(f"{column}_sum"), F.lit(0))


def mean(column: str) -> Column:
    """Mean over the facts that have a value."""
    return F.try_divide(F.sum(f"{column}_sum").cast("double"), F.sum(f"{column}_n").cast("double"))


def in_range(rollup: DataFrame, start=None, end=None) -> DataFrame:
    """F1 / F2 on a ticket rollup: dates from ``start`` to ``end``, of the last one
    only the tickets of midnight; the default is the first and last date."""
    if start is None or end is None:
        b = rollup.agg(F.struct(F.min("ticket_date").alias("a"), F.max("ticket_date").alias("b")).alias("s")).select("s").scalar()
        start = b.getField("a") if start is None else start
        end = b.getField("b") if end is None else end
    start, end = (v if isinstance(v, Column) else F.lit(str(v)).cast("date") for v in (start, end))
    day = F.col("ticket_date")
    return rollup.where((day >= start) & ((day < end) | ((day == end) & F.col("at_midnight"))))


def kpi_summary(r: DataFrame) -> DataFrame:
    """K1."""
    return r.agg(total("px_count").cast("long").alias("total_passengers"),
                 total("px_total_amount").cast("double").alias("total_revenue"),
                 total("travelled_KM").cast("double").alias("total_distance"), mean("revenue_per_km").alias("avg_epkm"))


def route_passengers(r: DataFrame, n: int = 5, largest: bool = True) -> DataFrame:
    """A1 / A2: the routes with most (fewest) passengers."""
    g = r.where(F.col("route_no").isNotNull()).groupBy("route_no").agg(total("px_count").cast("long").alias("passengers"))
    out = top_k(g, "passengers", "route_no", n, largest)
    return out if largest else sort_by(out, "passengers", "route_no")


def daily_revenue(r: DataFrame) -> DataFrame:
    """A3: revenue per day, empty days 0."""
    per_day = r.where(F.col("ticket_date").isNotNull()).groupBy(F.col("ticket_date").alias("day")).agg(
        total("px_total_amount").cast("double").alias("revenue"))
    return spine.fill_bins(per_day, "day", "D", ["revenue"])


def peak_days(r: DataFrame, n: int = 3) -> DataFrame:
    """A4."""
    return top_k(daily_revenue(r), "revenue", "day", n)


def monthly_distance(r: DataFrame) -> DataFrame:
    """A15."""
    return (r.where(F.col("ticket_date").isNotNull()).groupBy(month_start(F.col("ticket_date")).alias("month_start"))
            .agg(total("travelled_KM").cast("double").alias("distance")))


def sustainability(r: DataFrame) -> DataFrame:
    """K9 with all bus types; each of the selector's choices (F10) is in it: with
    one type selected, ``all_km`` is that type's km."""
    km = lambda name: F.coalesce(F.sum(F.when(F.col("service_type") == name, F.col("travelled_KM_sum"))), F.lit(0))
    k = r.agg(km(EV).cast("double").alias("ev_km"), km(DIESEL).cast("double").alias("diesel_km"),
              total("travelled_KM").cast("double").alias("all_km"))
    f = F.lit(DIESEL_KG_CO2_PER_KM)
    return (k.withColumn("co2_emitted", F.col("diesel_km") * f)
            .withColumn("co2_saved", F.col("all_km") * f - F.col("co2_emitted")))


def top_ev_routes(r: DataFrame, n: int = 3) -> DataFrame:
    """A16."""
    g = (r.where((F.col("service_type") == EV) & F.col("route_no").isNotNull()).groupBy("route_no")
         .agg(total("travelled_KM").cast("double").alias("ev_km")))
    return top_k(g, "ev_km", "route_no", n)


def kpi_trips(r: DataFrame) -> DataFrame:
    """K7 (K6 is its columns without the first and the running time)."""
    return r.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("total_trips"),
                 total("total_count").cast("long").alias("total_passengers"),
                 total("total_amount").cast("double").alias("total_revenue"),
                 total("travel_distance").cast("double").alias("total_distance"),
                 F.coalesce(mean("running_time"), F.lit(0.0)).alias("avg_running_time"),
                 F.coalesce(mean("Epkm"), F.lit(0.0)).alias("avg_epkm"))


def monthly_revenue(r: DataFrame, months_from: DataFrame | None = None) -> DataFrame:
    """By month name, in calendar order."""
    agg = (r.where(F.col("month").isNotNull()).groupBy("month")
           .agg(total("total_amount").alias("total_amount"), total("total_count").alias("total_count")))
    months = (r if months_from is None else months_from).select("month").distinct()
    no = month_number_of_name(F.col("month")).cast("long")
    return months.join(agg, "month", "left").select(no.alias("month_no"), "month", "total_amount", "total_count").orderBy("month_no")


def daily_revenue_in_month(r: DataFrame, month: str) -> DataFrame:
    """Revenue per date of one month name."""
    return (r.where(F.col("month") == month).groupBy("running_date")
            .agg(total("total_amount").cast("double").alias("total_amount")))


def dow_pattern(r: DataFrame) -> DataFrame:
    """Means by weekday, all seven, 0 filled."""
    agg = (r.where(F.col("day_of_week").isNotNull()).groupBy("day_of_week")
           .agg(mean("total_amount").alias("avg_revenue"), mean("total_count").alias("avg_passengers")))
    return spine.reindex(agg, "day_of_week", DAY_NAMES, fill=0, order_col="day_no")


def schedule_stats(r: DataFrame, min_trips: int = 5) -> DataFrame:
    """A18."""
    g = (r.where(F.col("schedule_number").isNotNull()).groupBy("schedule_number")
         .agg(mean("Epkm").alias("avg_epkm"), F.sum("trip_rows").alias("total_trips"),
              total("total_amount").cast("double").alias("total_revenue"),
              total("travel_distance").cast("double").alias("total_distance")))
    return sort_by(g.where(F.col("total_trips") >= min_trips), "avg_epkm", "schedule_number")


def trip_routes_by_passengers(r: DataFrame, n: int = 10) -> DataFrame:
    """A28."""
    g = r.where(F.col("route_no").isNotNull()).groupBy("route_no").agg(total("total_count").alias("total_count"))
    return top_k(g, "total_count", "route_no", n)


def monthly_passengers(r: DataFrame) -> DataFrame:
    """Per month end, empty months kept."""
    per_month = (r.where(F.col("running_date").isNotNull())
                 .groupBy(spine.bin_label(F.col("running_date"), "M").alias("month_end"))
                 .agg(total("total_count").alias("total_passengers"), mean("total_count").alias("avg_per_trip")))
    return spine.fill_bins(per_month, "month_end", "M", ["total_passengers"])


def epkm_trend(r: DataFrame, freq: str = "D") -> DataFrame:
    """Mean EPKM per bin and over all."""
    bins = (r.where(F.col("running_date").isNotNull()).groupBy(spine.bin_label(F.col("running_date"), freq).alias("period"))
            .agg(mean("Epkm").alias("avg_epkm"), F.sum("Epkm_sum").alias("_s"), F.sum("Epkm_n").alias("_n")))
    every = Window.partitionBy(F.lit(0))       # over calendar bins
    overall = F.try_divide(F.sum("_s").over(every), F.sum("_n").over(every))
    return (spine.fill_bins(bins, "period", freq, ["_s", "_n"])
            .select("period", "avg_epkm", overall.alias("system_avg_epkm")).orderBy("period"))


def daily_totals(r: DataFrame, column: str) -> DataFrame:
    """Sum per date."""
    return r.where(F.col("running_date").isNotNull()).groupBy("running_date").agg(total(column).alias(column))


def in_weeks(r: DataFrame, weeks: list) -> DataFrame:
    """F13 on a trip rollup: rows of the ISO weeks."""
    return r.where(iso_week(F.col("running_date")).isin(list(weeks)))
