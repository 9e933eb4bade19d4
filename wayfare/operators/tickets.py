"""Ticket-level KPIs, rankings, alerts and trends.

Inputs are enriched tickets (``enrich.enrich_tickets``), usually after
``filters.filter_global``.  Every grouped operator drops NULL group keys
first (a pandas ``groupby`` does), and sums of empty / all-NULL groups are 0.
Thresholds relative to a mean of aggregates use a scalar subquery: the mean
is computed once and referenced as a constant, with no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import month_start, null_safe_sum, safe_div
from . import spine
from .bitmaps import count_ids
from .ranking import sort_by, top_k

EV = "EV INTERSTATE"  # fixed value: service name of electric buses
DIESEL = "MANUAL LOCAL INTERSTATE"  # fixed value: service name of diesel buses
DIESEL_KG_CO2_PER_KM = 0.3  # fixed value: emission factor of a diesel km


def _grouped(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


# --------------------------------------------------------------------- KPIs
def kpi_summary(df: DataFrame) -> DataFrame:
    """K1: passengers, revenue, (mapped) distance, mean of per-row EPKM-A."""
    return df.agg(null_safe_sum("px_count").cast("long").alias("total_passengers"),
                  null_safe_sum("px_total_amount").cast("double").alias("total_revenue"),
                  null_safe_sum("travelled_KM").cast("double").alias("total_distance"),
                  F.avg("revenue_per_km").alias("avg_epkm"))


def kpi_route(route_df: DataFrame) -> DataFrame:
    """K2: distinct trips, passengers, revenue of one route's rows."""
    return route_df.agg(F.count_distinct("trip_no").alias("distinct_trips"),
                        null_safe_sum("px_count").cast("long").alias("total_passengers"),
                        null_safe_sum("px_total_amount").cast("double").alias("total_revenue"))


def kpi_fleet(fleet_df: DataFrame, all_df: DataFrame, dense_trips: bool = True) -> DataFrame:
    """K3/K4: fleet totals.

    ``sum_trip_no`` reproduces the dashboard's "Total Trips" (a sum of trip
    ids); ``distinct_trips`` is the count of trips.  Active vehicles count a
    NULL vehicle as one more value; the fleet size is the distinct non-NULL
    vehicles of the whole table; idle = fleet size - active.

    Trips and sums come from one pass by trip-number bitmaps (``dense_trips=False``:
    by a grouping, for trip numbers far apart), vehicles from one grouping of both
    frames' vehicle column: no Expand over the facts.
    """
    k = count_ids(fleet_df, "trip_no", {"km": F.col("travelled_KM"), "numbers": F.col("trip_no")}, dense_trips)
    seen = (all_df.select("vehicle_no", F.lit(False).alias("a"), F.lit(True).alias("t"))
            .unionByName(fleet_df.select("vehicle_no", F.lit(True).alias("a"), F.lit(False).alias("t")))
            .groupBy("vehicle_no").agg(F.max("a").alias("active"), F.max("t").alias("total")))
    vehicles = seen.agg(F.struct(F.count_if("active").alias("active"),
                                 F.count_if(F.col("total") & F.col("vehicle_no").isNotNull()).alias("total")).alias("v"))
    v = vehicles.select("v").scalar()
    return (k.select(F.col("km").cast("double").alias("total_distance"), F.col("numbers").cast("long").alias("sum_trip_no"),
                     F.col("distinct_ids").alias("distinct_trips"), v.getField("active").alias("active_vehicles"),
                     v.getField("total").alias("total_vehicles"))
             .withColumn("idle_vehicles", F.col("total_vehicles") - F.col("active_vehicles")))


def efficiency_score(avg_rev, avg_px):
    """mean(rev/km) / mean(px/km); 0 when the denominator is 0, NULL when it
    is NULL (NaN is truthy in the dashboard's ``x if mean else 0``)."""
    return F.when(avg_px == 0, F.lit(0.0)).otherwise(safe_div(avg_rev, avg_px))


def kpi_optimization(df: DataFrame) -> DataFrame:
    """K5: mean passengers/km, mean revenue/km and their ratio."""
    k = df.agg(F.avg("passengers_per_km").alias("avg_passengers_per_km"),
               F.avg("revenue_per_km").alias("avg_revenue_per_km"))
    return k.withColumn("efficiency_score",
                        efficiency_score(F.col("avg_revenue_per_km"), F.col("avg_passengers_per_km")))


def sustainability_summary(df: DataFrame, bus_type: str = "All") -> DataFrame:
    """K9 (F10, F11): EV / diesel / all km and CO2 estimates.

    Emitted = diesel km * 0.3; saved = all km * 0.3 - emitted, so km of any
    other service counts as saved.
    """
    if bus_type in (EV, DIESEL):
        df = df.where(F.col("service_type") == F.lit(bus_type))
    elif bus_type != "All":
        raise ValueError(f"bus_type must be 'All', {EV!r} or {DIESEL!r}")
    km = F.col("travelled_KM")
    k = df.agg(
        null_safe_sum(F.when(F.col("service_type") == EV, km)).cast("double").alias("ev_km"),
        null_safe_sum(F.when(F.col("service_type") == DIESEL, km)).cast("double").alias("diesel_km"),
        null_safe_sum(km).cast("double").alias("all_km"))
    f = F.lit(DIESEL_KG_CO2_PER_KM)
    return (k.withColumn("co2_emitted", F.col("diesel_km") * f)
             .withColumn("co2_saved", F.col("all_km") * f - F.col("co2_emitted")))


# ------------------------------------------------------------ route ranking
def route_passengers(df: DataFrame) -> DataFrame:
    return (_grouped(df, "route_no").groupBy("route_no")
            .agg(null_safe_sum("px_count").cast("long").alias("passengers")))


def top_routes_by_passengers(df: DataFrame, n: int = 5) -> DataFrame:
    """A1: the ``n`` routes with most passengers."""
    return top_k(route_passengers(df), "passengers", "route_no", n, largest=True)


def bottom_routes_by_passengers(df: DataFrame, n: int = 5) -> DataFrame:
    """A2: the ``n`` routes with fewest passengers, shown from the most to the
    fewest."""
    return sort_by(top_k(route_passengers(df), "passengers", "route_no", n, largest=False), "passengers", "route_no")


def daily_revenue_filled(df: DataFrame) -> DataFrame:
    """A3: revenue per calendar day, days without tickets as 0."""
    return spine.resample(df, "ticket_datetime", "D", sums=[("revenue", "px_total_amount")],
                          label="day")


def peak_days(df: DataFrame, n: int = 3) -> DataFrame:
    """A4: the ``n`` days of highest revenue (over the gap-filled series)."""
    return top_k(daily_revenue_filled(df), "revenue", "day", n)


# ------------------------------------------------------------ schedules
def schedule_efficiency(route_df: DataFrame) -> DataFrame:
    """A5: per schedule revenue, mean km, distinct trips and EPKM-E = revenue /
    mean km, highest first.  A mean km of 0 gives +/-inf (0 / 0: NULL), as the
    reference's division does, so such a schedule ranks first."""
    g = (_grouped(route_df, "schedule_no").groupBy("schedule_no")
         .agg(null_safe_sum("px_total_amount").cast("double").alias("revenue"),
              F.avg("travelled_KM").alias("mean_km"),
              F.count_distinct("trip_no").alias("trips")))
    epkm = safe_div(F.col("revenue"), F.col("mean_km"))
    inf = F.when(F.col("revenue") > 0, F.lit(float("inf"))).when(
        F.col("revenue") < 0, F.lit(float("-inf")))
    epkm = F.when(F.col("mean_km") == 0, inf).otherwise(epkm)
    return sort_by(g.withColumn("epkm", epkm), "epkm", "schedule_no")


def top_schedules(route_df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` schedules of highest EPKM-E."""
    return top_k(schedule_efficiency(route_df), "epkm", "schedule_no", n)


def trip_stats(route_df: DataFrame) -> DataFrame:
    """Per trip revenue, mean km and passengers."""
    return (_grouped(route_df, "trip_no").groupBy("trip_no")
            .agg(null_safe_sum("px_total_amount").cast("double").alias("revenue"),
                 F.avg("travelled_KM").alias("mean_km"),
                 null_safe_sum("px_count").cast("long").alias("passengers")))


def leaking_trips(route_df: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Trips whose revenue is below ``ratio`` x the mean trip revenue."""
    stats = trip_stats(route_df)
    mean_rev = stats.agg(F.avg("revenue").alias("m")).select("m").scalar()
    return stats.where(F.col("revenue") < mean_rev * F.lit(ratio))


def revenue_leakage(route_df: DataFrame, ratio: float = 0.7, n: int = 3) -> DataFrame:
    """The ``n`` lowest-revenue trips among the leaking ones."""
    return top_k(leaking_trips(route_df, ratio), "revenue", "trip_no", n, largest=False)


# ------------------------------------------------------------ optimisation
def _mean_ratios(g: DataFrame) -> DataFrame:
    return g.withColumn("efficiency_score", efficiency_score(F.col("revenue_per_km"), F.col("passengers_per_km")))


def route_optimization_stats(df: DataFrame) -> DataFrame:
    """A9-A11 in one aggregate: passenger density, revenue efficiency and
    the efficiency score per route."""
    return _mean_ratios(_grouped(df, "route_no").groupBy("route_no")
                        .agg(F.avg("passengers_per_km").alias("passengers_per_km"),
                             F.avg("revenue_per_km").alias("revenue_per_km")))


RATIOS = ("passengers_per_km", "revenue_per_km")


def _selected_by_route(df: DataFrame, min_km: int) -> DataFrame:
    """Sums and counts of the two ratios by route (NULL: a row of its own) under
    the default distance selection (F7: ``min_km`` to the whole part of the
    greatest km), in one pass over the tickets.

    Only tickets with a fractional km in the top whole km of all are beyond the
    default bound.  Each (route, whole km) keeps its fractional tickets' sums
    apart, each route those of its own top km, and the top km of all routes
    decides whether they count: the bound is found among one row per route."""
    km = F.col("travelled_KM")
    rows = df.where(km.isNotNull() & (km >= min_km)).withColumn("_whole", F.floor(km).cast("long"))
    over = km > F.col("_whole")
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(over).alias("on_rows")]
    parts = counts + [e for c in RATIOS for e in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"),
                                         F.sum(F.when(over, F.col(c))).alias(f"os_{c}"), F.count(F.when(over, F.col(c))).alias(f"on_{c}"))]
    by_km = rows.groupBy("route_no", "_whole").agg(*parts)
    sums = ["n_rows", *[f"{f}_{c}" for c in RATIOS for f in "sn"]]
    top = F.max_by(F.struct(*[f"o{c}" for c in sums]), F.col("_whole"))
    routes = by_km.groupBy("route_no").agg(*[F.sum(c).alias(c) for c in sums], top.alias("_top"), F.max("_whole").alias("_whole"))
    bound = F.max("_whole").over(Window.partitionBy(F.lit(0)))  # over one row per route
    cut = F.col("_whole") == F.col("_bound")
    return routes.withColumn("_bound", bound).select("route_no", *[
        (F.col(c) - F.when(cut, F.coalesce(F.col(f"_top.o{c}"), F.lit(0))).otherwise(0)).alias(c)
        for c in sums]).where(F.col("n_rows") > 0)


def default_optimization(df: DataFrame, min_km: int = 0) -> DataFrame:
    """K5 under the default distance selection of all routes (one pass)."""
    k = _selected_by_route(df, min_km).agg(*[
        F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}").cast("double")).alias(f"avg_{c}") for c in RATIOS])
    return k.withColumn("efficiency_score", efficiency_score(F.col("avg_revenue_per_km"), F.col("avg_passengers_per_km")))


def default_route_optimization(df: DataFrame, min_km: int = 0) -> DataFrame:
    """A9-A11 under the default distance selection of all routes (one pass);
    routes without a selected ticket have no row."""
    g = _selected_by_route(df, min_km).where(F.col("route_no").isNotNull())
    return _mean_ratios(g.select("route_no", *[F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}").cast("double")).alias(c) for c in RATIOS]))


def _ranked(df: DataFrame, value: str, default_selection: bool) -> DataFrame:
    g = default_route_optimization(df) if default_selection else route_optimization_stats(df)
    return sort_by(g.select("route_no", value), value, "route_no")


def route_density(df: DataFrame, default_selection: bool = False) -> DataFrame:
    """Mean passengers per km by route, descending.  With
    ``default_selection`` (here and below) the page's default distance selection
    is applied first, in the same pass."""
    return _ranked(df, "passengers_per_km", default_selection)


def high_density_routes(df: DataFrame, above: float = 5.0, default_selection: bool = False) -> DataFrame:
    """A9 alert: routes whose density exceeds ``above``."""
    return route_density(df, default_selection).where(F.col("passengers_per_km") > F.lit(above))


def route_revenue_efficiency(df: DataFrame, default_selection: bool = False) -> DataFrame:
    """A10: mean revenue per km by route, descending."""
    return _ranked(df, "revenue_per_km", default_selection)


def route_efficiency(df: DataFrame, default_selection: bool = False) -> DataFrame:
    """Efficiency score by route, descending."""
    return _ranked(df, "efficiency_score", default_selection)


def low_efficiency_routes(df: DataFrame, below: float = 0.8, default_selection: bool = False) -> DataFrame:
    """A11 alert: routes scoring below ``below``."""
    return route_efficiency(df, default_selection).where(F.col("efficiency_score") < F.lit(below))


# ------------------------------------------------------------ fleet
def trips_per_vehicle(fleet_df: DataFrame) -> DataFrame:
    """Distinct trips per vehicle, descending."""
    g = (_grouped(fleet_df, "vehicle_no").groupBy("vehicle_no")
         .agg(F.count_distinct("trip_no").alias("trips")))
    return sort_by(g, "trips", "vehicle_no")


def _vehicles_vs_mean(fleet_df: DataFrame, factor: float, above: bool) -> DataFrame:
    tpv = trips_per_vehicle(fleet_df)
    mean_trips = tpv.agg(F.avg("trips").alias("m")).select("m").scalar()
    bound = mean_trips * F.lit(factor)
    return tpv.where(F.col("trips") > bound if above else F.col("trips") < bound)


def underutilized_vehicles(fleet_df: DataFrame, factor: float = 0.7) -> DataFrame:
    """Vehicles with fewer than ``factor`` x the mean trips per vehicle."""
    return _vehicles_vs_mean(fleet_df, factor, above=False)


def overused_vehicles(fleet_df: DataFrame, factor: float = 1.3) -> DataFrame:
    """Vehicles with more than ``factor`` x the mean trips per vehicle."""
    return _vehicles_vs_mean(fleet_df, factor, above=True)


def monthly_distance(fleet_df: DataFrame) -> DataFrame:
    """Km per calendar month (month-start label, no empty months)."""
    return (fleet_df.where(F.col("ticket_datetime").isNotNull())
            .groupBy(month_start(F.col("ticket_datetime")).alias("month_start"))
            .agg(null_safe_sum("travelled_KM").cast("double").alias("distance")))


def top_ev_routes(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` routes with the most EV km."""
    ev = _grouped(df.where(F.col("service_type") == EV), "route_no")
    g = ev.groupBy("route_no").agg(null_safe_sum("travelled_KM").cast("double").alias("ev_km"))
    return top_k(g, "ev_km", "route_no", n)
