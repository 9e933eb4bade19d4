"""Trip-level KPIs, rankings, calendar patterns and trends (K6-K8, K10,
A17-A38, A41-A44, W1).

Inputs are cleaned trip tables (``clean.clean_trips_*``).  NULL group keys
are dropped before grouping; sums of empty groups are 0; category spines
(month names, day names) are joined from the left so absent categories
appear with NULL (or 0 where the dashboard fills).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY_NAMES, month_number_of_name, null_safe_sum, safe_div
from . import spine
from .domains import available_months
from .quantiles import exact_quantiles
from .ranking import sort_by, top_k


MAX_PIVOT = 500  # columns of a pivot


def _g(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


# --------------------------------------------------------------------- KPIs
def kpi_trips(df: DataFrame) -> DataFrame:
    """K6: passengers, revenue, distance, mean EPKM (0 when no values)."""
    return df.agg(null_safe_sum("total_count").cast("double").alias("total_passengers"),
                  null_safe_sum("total_amount").cast("double").alias("total_revenue"),
                  null_safe_sum("travel_distance").cast("double").alias("total_distance"),
                  F.coalesce(F.avg("Epkm"), F.lit(0.0)).alias("avg_epkm"))


def kpi_trips_extended(df: DataFrame) -> DataFrame:
    """K7: K6 plus the row count as trips and the mean running time (0 when
    the column is absent or has no numeric value)."""
    rt = (F.coalesce(F.avg("running_time"), F.lit(0.0)) if "running_time" in df.columns
          else F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("total_trips"),
                  null_safe_sum("total_count").cast("long").alias("total_passengers"),
                  null_safe_sum("total_amount").cast("double").alias("total_revenue"),
                  null_safe_sum("travel_distance").cast("double").alias("total_distance"),
                  rt.cast("double").alias("avg_running_time"),
                  F.coalesce(F.avg("Epkm"), F.lit(0.0)).alias("avg_epkm"))


# fixed values: metric labels of the month dashboard's summary table
KPI_LABELS = ["Total Passengers", "Total Revenue (₹)", "Total Distance (KM)", "Avg EPKM (₹/KM)"]


def kpi_long(df: DataFrame) -> DataFrame:
    """K8: the four month-dashboard KPIs as (Metric, Value) rows."""
    k = df.agg(null_safe_sum("total_passenger").cast("double").alias("a"),
               null_safe_sum("total_amount").cast("double").alias("b"),
               null_safe_sum("travel_distance").cast("double").alias("c"),
               F.avg("Epkm").cast("double").alias("d"))
    pairs = ", ".join(f"'{lbl}', {c}" for lbl, c in zip(KPI_LABELS, "abcd"))
    return k.selectExpr(f"stack(4, {pairs}) as (Metric, Value)")


def system_average(df: DataFrame, column: str = "Epkm"):
    """The mean of a column over all rows, as a scalar-subquery column."""
    return df.agg(F.avg(column).alias("m")).select("m").scalar()


# ------------------------------------------------------------ monthly views
def monthly_revenue(df: DataFrame, months_from: DataFrame | None = None) -> DataFrame:
    """Revenue and passengers per month name (years merged), re-indexed
    to the months present in ``months_from`` (default: ``df``) in calendar
    order; months without rows get NULL."""
    agg = (_g(df, "month").groupBy("month")
           .agg(null_safe_sum("total_amount").alias("total_amount"), null_safe_sum("total_count").alias("total_count")))
    months = available_months(months_from if months_from is not None else df)
    return months.join(agg, "month", "left").orderBy(month_number_of_name(F.col("month")))


def daily_revenue_in_month(df: DataFrame, month: str) -> DataFrame:
    """Revenue per date inside one month name, no gap filling."""
    return (_g(df.where(F.col("month") == F.lit(month)), "running_date")
            .groupBy(F.to_date("running_date").alias("running_date"))
            .agg(null_safe_sum("total_amount").cast("double").alias("total_amount")))


def revenue_by_month_dow(df: DataFrame, days=None) -> DataFrame:
    """Mean revenue per record by (month, day); the day selection
    filters the aggregate afterwards."""
    out = (_g(df, "month", "day_of_week").groupBy("month", "day_of_week")
           .agg(F.avg("total_amount").alias("avg_per_trip")))
    if days:
        out = out.where(F.col("day_of_week").isin(list(days)))
    return out


def _dow_spine(agg: DataFrame, fill=None) -> DataFrame:
    return spine.reindex(agg, "day_of_week", DAY_NAMES, fill=fill, order_col="day_no")


def dow_pattern(df: DataFrame) -> DataFrame:
    """Mean revenue and passengers by weekday, all 7 days, 0 filled."""
    agg = (_g(df, "day_of_week").groupBy("day_of_week")
           .agg(F.avg("total_amount").alias("avg_revenue"),
                F.avg(F.col("total_count").cast("double")).alias("avg_passengers")))
    return _dow_spine(agg, fill=0)


def route_dow(df: DataFrame, route: str) -> DataFrame:
    """One route by weekday: revenue, passengers, mean EPKM; 0 filled."""
    r = df.where(F.col("route_no") == F.lit(route))
    agg = (_g(r, "day_of_week").groupBy("day_of_week")
           .agg(null_safe_sum("total_amount").cast("double").alias("Total_Revenue"),
                null_safe_sum(F.col("total_count").cast("double")).alias("Total_Passengers"),
                F.avg("Epkm").alias("Average_EPKM")))
    return _dow_spine(agg, fill=0)


def dow_passengers(df: DataFrame) -> DataFrame:
    """Mean and total passengers by weekday, 7 days, no fill."""
    agg = (_g(df, "day_of_week").groupBy("day_of_week")
           .agg(F.avg(F.col("total_count").cast("double")).alias("avg_passengers"),
                null_safe_sum("total_count").cast("long").alias("total_passengers")))
    return _dow_spine(agg)


def dow_service_pivot(df: DataFrame, services: list | None = None) -> DataFrame:
    """Mean passengers by weekday x service, services as columns.

    The service list is taken from the data when not given (one distinct
    query, of at most ``MAX_PIVOT`` services, else an error); pass it explicitly
    to keep the plan fully lazy.
    """
    d = _g(df, "day_of_week", "service_type")
    if services is None:
        services = [r[0] for r in d.select("service_type").distinct()
                    .orderBy("service_type").limit(MAX_PIVOT + 1).collect()]
    if len(services) > MAX_PIVOT:
        raise ValueError(f"a pivot of more than {MAX_PIVOT} services; select some")
    return (d.groupBy("day_of_week").pivot("service_type", services)
             .agg(F.avg(F.col("total_count").cast("double"))))


def dow_service_map(df: DataFrame) -> DataFrame:
    """A31 in map form: mean passengers by weekday as one map from service to
    mean.  One grouped pass, no column per service: nothing is known of the
    services before, and their number is not limited."""
    g = (_g(df, "day_of_week", "service_type").groupBy("day_of_week", "service_type")
         .agg(F.avg(F.col("total_count").cast("double")).alias("m")))
    return g.groupBy("day_of_week").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("service_type", "m")))).alias("avg_passengers"))


def widen(mapped: DataFrame, services: list, column: str = "avg_passengers") -> DataFrame:
    """The entries of a map column for the given services as columns."""
    rest = [c for c in mapped.columns if c != column]
    return mapped.select(*rest, *[F.try_element_at(column, F.lit(s)).alias(s) for s in services])


# ------------------------------------------------------------ schedules
def _schedule_table(df: DataFrame, min_trips: int) -> DataFrame:
    g = (_g(df, "schedule_number").groupBy("schedule_number")
         .agg(F.avg("Epkm").alias("avg_epkm"), F.count("trip_number").alias("total_trips"),
              null_safe_sum("total_amount").cast("double").alias("total_revenue"),
              null_safe_sum("travel_distance").cast("double").alias("total_distance")))
    return g.where(F.col("total_trips") >= F.lit(min_trips))


def schedule_stats(df: DataFrame, min_trips: int = 5) -> DataFrame:
    """Mean EPKM, record count, revenue and distance per schedule,
    keeping schedules with at least ``min_trips`` records; EPKM descending."""
    return sort_by(_schedule_table(df, min_trips), "avg_epkm", "schedule_number")


def schedule_epkm_vs_system(df: DataFrame, min_trips: int = 5) -> DataFrame:
    """A18 + K10: schedule means next to the system-wide mean EPKM."""
    sys_avg = system_average(df)
    return (schedule_stats(df, min_trips).select("schedule_number", "avg_epkm")
            .withColumn("system_avg_epkm", sys_avg))


def schedule_summary(df: DataFrame, min_trips: int = 5) -> DataFrame:
    """Best and worst schedule by mean EPKM (ties: the smaller number) and
    the median of the schedule means (exact): one pass over the trips, all three
    from the slim schedule table that the quantile writes."""
    epkm, number = F.col("avg_epkm"), F.col("schedule_number")
    best = F.min(F.struct(epkm.isNull().alias("none"), (-epkm).alias("key"), number.alias("n"), epkm.alias("e")))
    worst = F.min(F.struct(epkm.isNull().alias("none"), epkm.alias("key"), number.alias("n"), epkm.alias("e")))
    out = exact_quantiles(_schedule_table(df, min_trips), "avg_epkm", {"median_epkm": 0.5},
                          also={"best": best, "worst": worst}, carry=["schedule_number"])
    return out.select(F.col("best.n").alias("best_schedule"), F.col("best.e").alias("best_epkm"),
                      F.col("worst.n").alias("worst_schedule"), F.col("worst.e").alias("worst_epkm"), "median_epkm")


def schedule_epkm_trend(df: DataFrame, schedules=None, min_trips: int = 5, n: int = 3) -> DataFrame:
    """Mean EPKM per (date, schedule) for the selected schedules;
    by default the ``n`` best schedules of ``schedule_stats`` (a left-semi
    join against the top-k keys, no driver round trip)."""
    if schedules is None:
        keys = top_k(schedule_stats(df, min_trips), "avg_epkm", "schedule_number", n, True).select("schedule_number")
        sel = df.join(keys, "schedule_number", "left_semi")
    else:
        sel = df.where(F.col("schedule_number").isin(list(schedules)))
    return (_g(sel, "running_date", "schedule_number")
            .groupBy(F.to_date("running_date").alias("running_date"), "schedule_number")
            .agg(F.avg("Epkm").alias("avg_epkm")))


def schedule_avg_epkm(df: DataFrame) -> DataFrame:
    """Mean EPKM per schedule, descending."""
    g = _g(df, "schedule_number").groupBy("schedule_number").agg(F.avg("Epkm").alias("Epkm"))
    return sort_by(g, "Epkm", "schedule_number")


def schedule_compare(df: DataFrame, schedules) -> DataFrame:
    """Mean EPKM of the selected schedules (non-empty list)."""
    if not schedules:
        raise ValueError("schedule_compare needs at least one schedule")
    return schedule_avg_epkm(df.where(F.col("schedule_number").isin(list(schedules))))


def trips_per_schedule_day(df: DataFrame) -> DataFrame:
    """Highest trip number per (date, schedule)."""
    return (_g(df, "running_date", "schedule_number")
            .groupBy(F.to_date("running_date").alias("running_date"), "schedule_number")
            .agg(F.max("trip_number").alias("trip_number")))


# ------------------------------------------------------------ routes
def route_totals(df: DataFrame, passengers: str = "total_count") -> DataFrame:
    return (_g(df, "route_no").groupBy("route_no")
            .agg(null_safe_sum(passengers).alias(passengers)))


def top_routes_by_passengers(df: DataFrame, n: int = 10, passengers: str = "total_count",
                             largest: bool = True) -> DataFrame:
    """A28 (and A1/A2 on the month sheet): top / bottom routes by passengers."""
    return top_k(route_totals(df, passengers), passengers, "route_no", n, largest)


def top_routes_by_epkm(df: DataFrame, n: int = 10) -> DataFrame:
    """Routes with the highest mean EPKM."""
    g = _g(df, "route_no").groupBy("route_no").agg(F.avg("Epkm").alias("Epkm"))
    return top_k(g, "Epkm", "route_no", n)


def route_scatter(df: DataFrame) -> DataFrame:
    """A34 + K10: per route totals / means with the overall passenger and
    EPKM means attached."""
    g = (_g(df, "route_no").groupBy("route_no")
         .agg(null_safe_sum("total_count").cast("long").alias("total_passengers"),
              F.avg(F.col("total_count").cast("double")).alias("avg_passengers"),
              F.avg("Epkm").alias("epkm"), F.count("trip_number").alias("total_trips")))
    overall = df.agg(F.struct(F.avg(F.col("total_count").cast("double")).alias("p"),
                              F.avg("Epkm").alias("e")).alias("s")).select("s").scalar()
    return (g.withColumn("overall_avg_passengers", overall.getField("p"))
             .withColumn("overall_avg_epkm", overall.getField("e")))


def top5_route_stats(df: DataFrame, n: int = 5) -> DataFrame:
    """The top routes by total passengers and by mean EPKM, as
    (ranking, route_no, value) rows."""
    stats = route_scatter(df)
    by_px = top_k(stats, "total_passengers", "route_no", n).select(
        F.lit("total_passengers").alias("ranking"), "route_no",
        F.col("total_passengers").cast("double").alias("value"))
    by_epkm = top_k(stats, "epkm", "route_no", n).select(
        F.lit("epkm").alias("ranking"), "route_no", F.col("epkm").alias("value"))
    return by_px.unionByName(by_epkm)


def route_epkm_stats(df: DataFrame) -> DataFrame:
    """A41 base: per route mean and total EPKM, passengers, distance."""
    return (_g(df, "route_no").groupBy("route_no")
            .agg(F.avg("Epkm").alias("avg_epkm"), null_safe_sum("Epkm").alias("total_epkm"),
                 null_safe_sum("total_count").cast("long").alias("total_passengers"),
                 null_safe_sum("travel_distance").cast("double").alias("total_distance")))


def topn_routes(df: DataFrame, n: int = 10, metric: str = "avg_epkm") -> DataFrame:
    """The ``n`` routes with the largest ``metric`` (avg_epkm or total_epkm)."""
    if metric not in ("avg_epkm", "total_epkm"):
        raise ValueError("metric must be avg_epkm or total_epkm")
    return top_k(route_epkm_stats(df), metric, "route_no", n)


# ------------------------------------------------------------ trends
def monthly_passengers(df: DataFrame) -> DataFrame:
    """Passengers per calendar month (month-end label), empty months
    with total 0 and mean NULL."""
    return spine.resample(df, "running_date", "M", sums=[("total_passengers", "total_count")],
                          means=[("avg_per_trip", "total_count")], label="month_end")


def yoy_monthly_passengers(df: DataFrame) -> DataFrame:
    """Passengers by (year, month name), only when the data spans more
    than one year (otherwise no rows)."""
    years = df.agg(F.count_distinct(F.year("running_date")).alias("y")).select("y").scalar()
    g = (_g(df, "running_date")
         .groupBy(F.year("running_date").cast("long").alias("year"),
                  F.date_format("running_date", "MMMM").alias("month_name"))
         .agg(null_safe_sum("total_count").cast("long").alias("total_passengers")))
    return g.where(years > 1)


def epkm_trend(df: DataFrame, freq: str = "D") -> DataFrame:
    """A36-A38 + K10: mean EPKM per day / W-MON week / month end (empty
    bins NULL) next to the overall mean EPKM (the benchmark line), which the
    bins' sums and counts give without a second pass over the trips."""
    dated = _g(df, "running_date")
    out = spine.resample(dated, "running_date", freq, means=[("avg_epkm", "Epkm")], sums=[("_sum", "Epkm")],
                         counts=[("_count", "Epkm")], label="period")
    every = Window.partitionBy(F.lit(0))
    mean = F.try_divide(F.sum("_sum").over(every), F.sum("_count").over(every))
    return out.select("period", "avg_epkm", mean.alias("system_avg_epkm")).orderBy("period")


def daily_totals(df: DataFrame, column: str) -> DataFrame:
    """Sum of ``column`` per date, no gap filling."""
    return (_g(df, "running_date").groupBy("running_date")
            .agg(null_safe_sum(column).alias(column)))


def service_avg_epkm(df: DataFrame, service: str = "color_line") -> DataFrame:
    """Mean EPKM per service; services whose mean is NULL are dropped."""
    return (_g(df, service).groupBy(service).agg(F.avg("Epkm").alias("Epkm"))
            .where(F.col("Epkm").isNotNull()))


def month_comparison(df: DataFrame) -> DataFrame:
    """Per month name: passengers, revenue, distance, mean EPKM, with
    the calendar month number for ordering."""
    g = (_g(df, "month").groupBy("month")
         .agg(null_safe_sum("total_passenger").cast("double").alias("Passengers"),
              null_safe_sum("total_amount").cast("double").alias("Revenue"),
              null_safe_sum("travel_distance").cast("double").alias("Distance"),
              F.avg("Epkm").alias("EPKM")))
    return g.withColumn("month_no", month_number_of_name(F.col("month")).cast("long")).orderBy("month_no")


def month_over_month(df: DataFrame) -> DataFrame:
    """W1 over A44 (at most 12 rows): month-on-month % change of the four
    measures, in calendar order; a change from 0 is +/-inf (0 to 0: NULL)."""
    base = month_comparison(df)
    w = Window.orderBy("month_no")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    out = base
    for c in ("Passengers", "Revenue", "Distance", "EPKM"):
        filled = F.last(F.col(c), ignorenulls=True).over(running)
        out = out.withColumn(f"_{c}_f", filled)
    for c, name in (("Passengers", "Passenger_MoM"), ("Revenue", "Revenue_MoM"),
                    ("Distance", "Distance_MoM"), ("EPKM", "EPKM_MoM")):
        cur, prev = F.col(f"_{c}_f"), F.lag(F.col(f"_{c}_f")).over(w)
        ratio = (safe_div(cur, prev) - F.lit(1.0)) * F.lit(100.0)
        inf = F.when(cur > 0, F.lit(float("inf"))).when(cur < 0, F.lit(float("-inf")))
        ratio = F.when(prev == 0, inf).otherwise(ratio)
        out = out.withColumn(name, ratio)
    return out.drop(*[f"_{c}_f" for c in ("Passengers", "Revenue", "Distance", "EPKM")]).orderBy("month_no")
