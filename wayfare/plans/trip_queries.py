"""Registered queries over trip-level facts (the three trip dashboards).

``trips_basic`` is the daily dashboard's cleaning (EPKM-B), ``trips_extended``
the drill-down dashboard's (EPKM-C), ``trips_monthly`` the month-comparison
dashboard's (EPKM-D).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import iso_week, month_number_of_name
from ..operators import clean, domains, filters, moments, rollup, stats
from ..operators import trips as TR
from ..scratch import keep_table, new_path
from ..session import scratch_path
from ..sources import export_csv, read_trips
from .catalog import query
from .params import MIN_TRIPS, ROUTE, TOP_N, Z_THRESHOLD
from .sql_fixtures import with_trips

BASIC_COLS = ["running_date", "month", "day_of_week", "service_type", "route_no",
              "schedule_number", "trip_number", "total_amount", "travel_distance", "Epkm",
              "total_count"]
BASIC_SQL = ", ".join(BASIC_COLS)
MONTHLY_COLS = ["running_date", "running_time", "color_line", "route_no", "schedule_number",
                "trip_number", "total_amount", "total_passenger", "travel_distance", "Epkm",
                "day_of_week", "month"]
MONTHLY_SQL = ", ".join(MONTHLY_COLS)


# ------------------------------------------------------------------ sources
@query("scan_trips", with_trips("SELECT * FROM trips"), doubles=["total_amount", "travel_distance"])
def q_scan_trips(inp):
    """The trip sheet stored as ``{root}/{sheet}`` parquet in the
    shared scratch folder and scanned back by sheet name."""
    root = scratch_path(inp.spark, "workbook", uuid.uuid4().hex)
    inp.trips.write.mode("overwrite").parquet(f"{root}/trip_revenue-5")
    return read_trips(inp.spark, root, sheet="trip_revenue-5")


@query("scan_dirty_sheet", with_trips("""
SELECT CAST(rd AS TIMESTAMP) AS running_date, color_line AS service_type, route_no, total_amount,
       0.0::DOUBLE AS travel_distance, CAST(0 AS BIGINT) AS trip_number, CAST(0 AS BIGINT) AS total_count,
       round_even(coalesce(total_amount / 1e-9, 0) * 100, 0) / 100 AS Epkm
FROM (SELECT rd, color_line, route_no, CASE WHEN length(schedule_number) = 1 THEN NULL ELSE total_amount END AS total_amount
      FROM trips_dated WHERE rd IS NOT NULL) WHERE total_amount IS NOT NULL"""),
    doubles=["total_amount", "travel_distance", "Epkm"])
def q_scan_dirty_sheet(inp):
    """The default sheet as CSV without distance, trip-number and
    passenger columns and with text among the amounts, read as it is and
    cleaned: bad amounts drop, absent columns are 0."""
    amount = F.when(F.length("schedule_number") == 1, F.lit("n/a")).otherwise(F.col("total_amount").cast("string"))
    thin = inp.trips.select("running_date", "color_line", "route_no", "schedule_number", amount.alias("total_amount"))
    path = export_csv(thin, scratch_path(inp.spark, "sheet", uuid.uuid4().hex), "trips", dated=False)
    df = clean.clean_trips_extended(read_trips(inp.spark, path, fmt="csv"))
    return df.select("running_date", "service_type", "route_no", "total_amount", F.col("travel_distance").cast("double").alias("travel_distance"),
                     "trip_number", "total_count", "Epkm")


# ------------------------------------------------------------------ cleaning
@query("clean_trips_basic", with_trips(f"SELECT {BASIC_SQL} FROM trips_basic"),
       doubles=["trip_number", "total_amount", "travel_distance", "Epkm", "total_count"])
def q_clean_trips_basic(inp):
    """Daily-dashboard cleaning with EPKM-B."""
    return inp.trips_basic.select(BASIC_COLS)


@query("clean_trips_extended", with_trips(f"SELECT {BASIC_SQL}, running_time FROM trips_ext"),
       doubles=["total_amount", "travel_distance", "Epkm", "running_time"])
def q_clean_trips_extended(inp):
    """Drill-down cleaning with EPKM-C."""
    return inp.trips_extended.select(*BASIC_COLS, "running_time")


@query("clean_trips_monthly", with_trips(f"SELECT {MONTHLY_SQL} FROM trips_month"),
       doubles=["running_time", "total_amount", "travel_distance", "Epkm"])
def q_clean_trips_monthly(inp):
    """Month-dashboard cleaning with EPKM-D."""
    return inp.trips_monthly.select(MONTHLY_COLS)


@query("calendar_parts", with_trips("""
SELECT running_date, month, day_of_week, CAST(weekofyear(running_date) AS BIGINT) AS iso_week,
       CAST(year(running_date) AS BIGINT) AS year, CAST(month(running_date) AS BIGINT) AS month_no
FROM trips_ext"""))
def q_calendar_parts(inp):
    """Month / day names, ISO week, year, month number."""
    d = inp.trips_extended
    return d.select("running_date", "month", "day_of_week",
                    iso_week(F.col("running_date")).alias("iso_week"),
                    F.year("running_date").cast("long").alias("year"),
                    month_number_of_name(F.col("month")).cast("long").alias("month_no"))


@query("default_missing_columns", with_trips("""
SELECT rd AS running_date, route_no, schedule_number, CAST(0 AS BIGINT) AS trip_number,
       CAST(0 AS BIGINT) AS total_count,
       round_even(coalesce(total_amount / NULLIF(travel_distance + 1e-9, 0), 0) * 100, 0) / 100 AS Epkm
FROM trips_dated WHERE rd IS NOT NULL AND total_amount IS NOT NULL AND travel_distance IS NOT NULL"""),
    doubles=["Epkm"])
def q_default_missing_columns(inp):
    """A sheet without trip-number and passenger columns gets them as 0."""
    thin = inp.trips.drop("trip_number", "total_count")
    return clean.clean_trips_extended(thin).select(
        "running_date", "route_no", "schedule_number", "trip_number", "total_count", "Epkm")


_EPKM_RAW = "SELECT route_no, schedule_number, running_date, total_amount, travel_distance, {e} AS epkm FROM trips"


@query("epkm_zero_guard", with_trips(_EPKM_RAW.format(
    e="round_even(coalesce(total_amount / NULLIF(travel_distance, 0), 0) * 100, 0) / 100")),
    doubles=["total_amount", "travel_distance", "epkm"])
def q_epkm_zero_guard(inp):
    """EPKM-B on raw rows (x/0, NaN -> 0, rounded half-even in binary)."""
    return inp.trips.select("route_no", "schedule_number", "running_date", "total_amount",
                            "travel_distance", clean.epkm_zero_guard().alias("epkm"))


@query("epkm_epsilon", with_trips(_EPKM_RAW.format(
    e="round_even(coalesce(total_amount / NULLIF(travel_distance + 1e-9, 0), 0) * 100, 0) / 100")),
    doubles=["total_amount", "travel_distance", "epkm"])
def q_epkm_epsilon(inp):
    """EPKM-C on raw rows (distance + 1e-9; a zero distance explodes)."""
    return inp.trips.select("route_no", "schedule_number", "running_date", "total_amount",
                            "travel_distance", clean.epkm_epsilon().alias("epkm"))


@query("epkm_null_guard", with_trips(_EPKM_RAW.format(
    e="coalesce(total_amount / NULLIF(travel_distance, 0), 0)")),
    doubles=["total_amount", "travel_distance", "epkm"])
def q_epkm_null_guard(inp):
    """EPKM-D on raw rows (distance 0 -> NULL, result NULL -> 0)."""
    return inp.trips.select("route_no", "schedule_number", "running_date", "total_amount",
                            "travel_distance", clean.epkm_null_guard().alias("epkm"))


@query("running_time_hours", with_trips("""
SELECT running_time AS running_time_text,
       TRY_CAST(split_part(running_time, ':', 1) AS DOUBLE)
         + TRY_CAST(split_part(running_time, ':', 2) AS DOUBLE) / 60.0
         + TRY_CAST(split_part(running_time, ':', 3) AS DOUBLE) / 3600.0 AS running_time
FROM trips_m_raw"""), doubles=["running_time"])
def q_running_time_hours(inp):
    """H:MM:SS text -> fractional hours (beyond 24 allowed)."""
    raw = inp.trips_monthly_raw.select(F.col("running_time").alias("running_time_text"),
                                       "running_time")
    return clean.running_time_hours(raw)


# ------------------------------------------------------------------ filters
@query("filter_calendar", with_trips(f"""
SELECT {BASIC_SQL} FROM trips_basic
WHERE month IN ('March') AND weekofyear(running_date) IN (10, 11)
  AND service_type IN ('ASIA', 'EUROPE', 'AFRICA')"""),
    doubles=["trip_number", "total_amount", "travel_distance", "Epkm", "total_count"])
def q_filter_calendar(inp):
    """One month with an ISO-week list, plus a service list."""
    spec = filters.CalendarFilter(months=["March"], weeks=[10, 11],
                                  services=["ASIA", "EUROPE", "AFRICA"])
    return spec.apply(inp.trips_basic).select(BASIC_COLS)


@query("filter_calendar_multi_month", with_trips(f"""
SELECT {BASIC_SQL} FROM trips_ext
WHERE month IN ('March', 'April') AND day_of_week IN ('Monday', 'Friday')
  AND route_no IN ('7', '21', '42', '77')"""),
    doubles=["total_amount", "travel_distance", "Epkm"])
def q_filter_calendar_multi_month(inp):
    """Two months (the week list is then ignored), days, routes."""
    spec = filters.CalendarFilter(months=["March", "April"], weeks=[10], days=["Monday", "Friday"],
                                  routes=["7", "21", "42", "77"])
    return spec.apply(inp.trips_extended).select(BASIC_COLS)


@query("filter_monthly_dashboard", with_trips(f"""
SELECT {MONTHLY_SQL} FROM trips_month
WHERE running_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
  AND color_line IN ('ASIA', 'nan') AND day_of_week IN ('Saturday', 'Sunday')"""),
    doubles=["running_time", "total_amount", "travel_distance", "Epkm"])
def q_filter_monthly_dashboard(inp):
    """date range AND service / day lists (empty route and month lists
    select everything)."""
    spec = filters.MonthlyDashboardFilter(date_range=("1996-01-01", "1997-12-31"),
                                          services=["ASIA", "nan"], days=["Saturday", "Sunday"])
    return spec.apply(inp.trips_monthly).select(MONTHLY_COLS)


@query("trips_per_schedule_day", with_trips("""
SELECT CAST(running_date AS DATE) AS running_date, schedule_number, max(trip_number) AS trip_number
FROM trips_ext WHERE route_no IN ('7', '13') AND schedule_number IS NOT NULL
GROUP BY 1, 2"""))
def q_trips_per_schedule_day(inp):
    """Routes 7 and 13 (all their schedules): max trip number per
    (date, schedule)."""
    sel = filters.cascade_route_schedule(inp.trips_extended, ["7", "13"])
    return TR.trips_per_schedule_day(sel)


@query("trips_per_schedule_day_selected", with_trips("""
SELECT CAST(running_date AS DATE) AS running_date, schedule_number, max(trip_number) AS trip_number
FROM trips_ext WHERE route_no IN ('7', '13') AND schedule_number IN ('3', '17')
GROUP BY 1, 2"""))
def q_trips_per_schedule_day_selected(inp):
    """Routes 7 and 13, then their schedules 3 and 17."""
    sel = filters.cascade_route_schedule(inp.trips_extended, ["7", "13"], ["3", "17"])
    return TR.trips_per_schedule_day(sel)


# ------------------------------------------------------------------ domains
@query("available_months", with_trips("""
SELECT DISTINCT CAST(month(running_date) AS BIGINT) AS month_no, strftime(running_date, '%B') AS month
FROM trips_basic"""))
def q_available_months(inp):
    """Months present, calendar order."""
    return domains.available_months(inp.trips_basic)


@query("available_days", with_trips("""
SELECT DISTINCT day_of_week, CAST(isodow(running_date) AS BIGINT) AS day_no FROM trips_month"""))
def q_available_days(inp):
    """U4: weekdays present, Monday first."""
    return domains.available_days(inp.trips_monthly)


@query("weeks_in_month", with_trips("""
SELECT DISTINCT CAST(weekofyear(running_date) AS BIGINT) AS iso_week FROM trips_basic
WHERE month(running_date) = 3"""))
def q_weeks_in_month(inp):
    """ISO weeks of March dates (all years)."""
    return domains.weeks_in_month(inp.trips_basic, 3)


@query("trip_domain_bounds", with_trips("""
SELECT CAST(min(running_date) AS DATE) AS min_date, CAST(max(running_date) AS DATE) AS max_date,
       CAST(CASE WHEN max(trip_number) > 0 THEN floor(max(trip_number)) ELSE 10 END AS BIGINT) AS max_trip_slider,
       CAST(least(20, count(DISTINCT route_no)) AS BIGINT) AS top_n_cap
FROM trips_ext"""))
def q_trip_domain_bounds(inp):
    """Date bounds, trip-number slider maximum, top-N cap."""
    return domains.trip_bounds(inp.trips_extended)


# ------------------------------------------------------------------ KPIs
@query("kpi_trips", with_trips("""
SELECT coalesce(sum(total_count), 0) AS total_passengers, coalesce(sum(total_amount), 0) AS total_revenue,
       coalesce(sum(travel_distance), 0) AS total_distance, coalesce(avg(Epkm), 0) AS avg_epkm
FROM trips_basic"""), doubles=["total_passengers", "total_revenue", "total_distance", "avg_epkm"])
def q_kpi_trips(inp):
    """K6: daily-dashboard KPIs."""
    return TR.kpi_trips(inp.trips_basic)


@query("kpi_trips_extended", with_trips("""
SELECT count(*) AS total_trips, CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_passengers,
       coalesce(sum(total_amount), 0) AS total_revenue, coalesce(sum(travel_distance), 0) AS total_distance,
       coalesce(avg(running_time), 0) AS avg_running_time, coalesce(avg(Epkm), 0) AS avg_epkm
FROM trips_ext"""), doubles=["total_revenue", "total_distance", "avg_running_time", "avg_epkm"])
def q_kpi_trips_extended(inp):
    """K7: drill-down KPIs (row count as trips, mean running time)."""
    return TR.kpi_trips_extended(inp.trips_extended)


@query("kpi_long", with_trips("""
, k AS (SELECT CAST(coalesce(sum(total_passenger), 0) AS DOUBLE) AS a, coalesce(sum(total_amount), 0) AS b,
               coalesce(sum(travel_distance), 0) AS c, avg(Epkm) AS d FROM trips_month)
SELECT 'Total Passengers' AS Metric, a AS Value FROM k
UNION ALL SELECT 'Total Revenue (₹)', b FROM k
UNION ALL SELECT 'Total Distance (KM)', c FROM k
UNION ALL SELECT 'Avg EPKM (₹/KM)', d FROM k"""), doubles=["Value"])
def q_kpi_long(inp):
    """K8: month-dashboard KPIs as (Metric, Value) rows."""
    return TR.kpi_long(inp.trips_monthly)


# ------------------------------------------------------------------ months / days
@query("monthly_revenue", with_trips("""
, agg AS (SELECT month, sum(total_amount) AS total_amount, CAST(sum(total_count) AS BIGINT) AS total_count
          FROM trips_ext WHERE month IS NOT NULL GROUP BY month),
months AS (SELECT DISTINCT CAST(month(running_date) AS BIGINT) AS month_no, strftime(running_date, '%B') AS month
           FROM trips_ext)
SELECT m.month_no, m.month, a.total_amount, a.total_count FROM months m LEFT JOIN agg a USING (month)"""),
    doubles=["total_amount"])
def q_monthly_revenue(inp):
    """Revenue and passengers per month name, calendar order."""
    return TR.monthly_revenue(inp.trips_extended)


@query("monthly_revenue_selected", with_trips("""
, agg AS (SELECT month, sum(total_amount) AS total_amount, CAST(sum(total_count) AS BIGINT) AS total_count
          FROM trips_ext WHERE month IN ('March', 'May') GROUP BY month),
months AS (SELECT DISTINCT CAST(month(running_date) AS BIGINT) AS month_no, strftime(running_date, '%B') AS month
           FROM trips_ext)
SELECT m.month_no, m.month, a.total_amount, a.total_count FROM months m LEFT JOIN agg a USING (month)"""),
    doubles=["total_amount"])
def q_monthly_revenue_selected(inp):
    """A17 under a month selection: the months of the whole table stay, those
    without selected rows as NULL."""
    sel = filters.CalendarFilter(months=["March", "May"]).apply(inp.trips_extended)
    return TR.monthly_revenue(sel, months_from=inp.trips_extended)


@query("daily_revenue_in_month", with_trips("""
SELECT CAST(running_date AS DATE) AS running_date, coalesce(sum(total_amount), 0) AS total_amount
FROM trips_basic WHERE month = 'March' GROUP BY 1"""), doubles=["total_amount"])
def q_daily_revenue_in_month(inp):
    """Revenue per date in March (any year)."""
    return TR.daily_revenue_in_month(inp.trips_basic, "March")


@query("revenue_by_month_dow", with_trips("""
SELECT month, day_of_week, avg(total_amount) AS avg_per_trip FROM trips_ext
WHERE month IS NOT NULL AND day_of_week IS NOT NULL AND day_of_week IN ('Saturday', 'Sunday')
GROUP BY 1, 2"""), doubles=["avg_per_trip"])
def q_revenue_by_month_dow(inp):
    """Mean revenue per record by (month, day), then a day list."""
    return TR.revenue_by_month_dow(inp.trips_extended, ["Saturday", "Sunday"])


@query("revenue_by_month_dow_all", with_trips("""
SELECT month, day_of_week, avg(total_amount) AS avg_per_trip FROM trips_ext
WHERE month IS NOT NULL AND day_of_week IS NOT NULL GROUP BY 1, 2"""), doubles=["avg_per_trip"])
def q_revenue_by_month_dow_all(inp):
    """Mean revenue per record by (month, day), all seven days."""
    return TR.revenue_by_month_dow(inp.trips_extended)


_DAYS = """
days AS (SELECT * FROM (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4),
                               ('Friday', 5), ('Saturday', 6), ('Sunday', 7)) t(day_of_week, day_no))"""


@query("dow_pattern", with_trips(f"""
, {_DAYS},
agg AS (SELECT day_of_week, avg(total_amount) AS avg_revenue, avg(CAST(total_count AS DOUBLE)) AS avg_passengers
        FROM trips_ext GROUP BY 1)
SELECT d.day_of_week, CAST(d.day_no AS BIGINT) AS day_no, coalesce(a.avg_revenue, 0) AS avg_revenue,
       coalesce(a.avg_passengers, 0) AS avg_passengers
FROM days d LEFT JOIN agg a USING (day_of_week)"""), doubles=["avg_revenue", "avg_passengers"])
def q_dow_pattern(inp):
    """Mean revenue and passengers by weekday, zero filled."""
    return TR.dow_pattern(inp.trips_extended)


@query("route_dow", with_trips(f"""
, {_DAYS},
agg AS (SELECT day_of_week, sum(total_amount) AS Total_Revenue, CAST(sum(total_count) AS DOUBLE) AS Total_Passengers,
               avg(Epkm) AS Average_EPKM
        FROM trips_ext WHERE route_no = '{ROUTE}' GROUP BY 1)
SELECT d.day_of_week, CAST(d.day_no AS BIGINT) AS day_no, coalesce(a.Total_Revenue, 0) AS Total_Revenue,
       coalesce(a.Total_Passengers, 0) AS Total_Passengers, coalesce(a.Average_EPKM, 0) AS Average_EPKM
FROM days d LEFT JOIN agg a USING (day_of_week)"""),
    doubles=["Total_Revenue", "Total_Passengers", "Average_EPKM"])
def q_route_dow(inp):
    """One route by weekday, zero filled."""
    return TR.route_dow(inp.trips_extended, ROUTE)


@query("dow_passengers", with_trips(f"""
, {_DAYS},
agg AS (SELECT day_of_week, avg(CAST(total_count AS DOUBLE)) AS avg_passengers,
               CAST(sum(total_count) AS BIGINT) AS total_passengers FROM trips_ext GROUP BY 1)
SELECT d.day_of_week, CAST(d.day_no AS BIGINT) AS day_no, a.avg_passengers, a.total_passengers
FROM days d LEFT JOIN agg a USING (day_of_week)"""), doubles=["avg_passengers"])
def q_dow_passengers(inp):
    """Mean and total passengers by weekday (no fill)."""
    return TR.dow_passengers(inp.trips_extended)


@query("dow_service_pivot", with_trips("""
SELECT day_of_week,
       avg(CASE WHEN service_type = 'AFRICA' THEN CAST(total_count AS DOUBLE) END) AS AFRICA,
       avg(CASE WHEN service_type = 'AMERICA' THEN CAST(total_count AS DOUBLE) END) AS AMERICA,
       avg(CASE WHEN service_type = 'ASIA' THEN CAST(total_count AS DOUBLE) END) AS ASIA,
       avg(CASE WHEN service_type = 'EUROPE' THEN CAST(total_count AS DOUBLE) END) AS EUROPE
FROM trips_ext WHERE day_of_week IS NOT NULL AND service_type IS NOT NULL GROUP BY 1"""),
    doubles=["AFRICA", "AMERICA", "ASIA", "EUROPE"])
def q_dow_service_pivot(inp):
    """Mean passengers by weekday x service (services as columns)."""
    return TR.dow_service_pivot(inp.trips_extended)


# ------------------------------------------------------------------ schedules
_SCHED = f"""
, ss AS (SELECT schedule_number, avg(Epkm) AS avg_epkm, count(trip_number) AS total_trips,
                coalesce(sum(total_amount), 0) AS total_revenue, coalesce(sum(travel_distance), 0) AS total_distance
         FROM trips_ext WHERE schedule_number IS NOT NULL GROUP BY 1 HAVING count(trip_number) >= {MIN_TRIPS})"""


@query("schedule_stats", with_trips(_SCHED + "\nSELECT * FROM ss"),
       doubles=["avg_epkm", "total_revenue", "total_distance"])
def q_schedule_stats(inp):
    """Schedule mean EPKM, records, revenue, distance (>= 5 records)."""
    return TR.schedule_stats(inp.trips_extended, MIN_TRIPS)


@query("schedule_epkm_vs_system", with_trips(_SCHED + """
SELECT schedule_number, avg_epkm, (SELECT avg(Epkm) FROM trips_ext) AS system_avg_epkm FROM ss"""),
    doubles=["avg_epkm", "system_avg_epkm"])
def q_schedule_epkm_vs_system(inp):
    """A18 + K10: schedule means against the system mean."""
    return TR.schedule_epkm_vs_system(inp.trips_extended, MIN_TRIPS)


@query("schedule_summary", with_trips(_SCHED + f"""
, best AS (SELECT schedule_number, avg_epkm FROM ss ORDER BY avg_epkm DESC NULLS LAST, schedule_number LIMIT 1),
worst AS (SELECT schedule_number, avg_epkm FROM ss ORDER BY avg_epkm ASC NULLS LAST, schedule_number LIMIT 1)
SELECT b.schedule_number AS best_schedule, b.avg_epkm AS best_epkm, w.schedule_number AS worst_schedule,
       w.avg_epkm AS worst_epkm, (SELECT quantile_cont(avg_epkm, 0.5) FROM ss) AS median_epkm
FROM best b, worst w"""), doubles=["best_epkm", "worst_epkm", "median_epkm"])
def q_schedule_summary(inp):
    """Best / worst schedule and the exact median of schedule means."""
    return TR.schedule_summary(inp.trips_extended, MIN_TRIPS)


@query("schedule_epkm_trend", with_trips(_SCHED + f"""
, top AS (SELECT schedule_number FROM ss ORDER BY avg_epkm DESC NULLS LAST, schedule_number LIMIT 3)
SELECT CAST(running_date AS DATE) AS running_date, schedule_number, avg(Epkm) AS avg_epkm
FROM trips_ext WHERE schedule_number IN (SELECT schedule_number FROM top) GROUP BY 1, 2"""),
    doubles=["avg_epkm"])
def q_schedule_epkm_trend(inp):
    """Daily mean EPKM of the three best schedules (semi-join)."""
    return TR.schedule_epkm_trend(inp.trips_extended, None, MIN_TRIPS, 3)


@query("schedule_avg_epkm", with_trips("""
SELECT schedule_number, avg(Epkm) AS Epkm FROM trips_basic WHERE schedule_number IS NOT NULL GROUP BY 1"""),
    doubles=["Epkm"])
def q_schedule_avg_epkm(inp):
    """Mean EPKM per schedule."""
    return TR.schedule_avg_epkm(inp.trips_basic)


@query("schedule_compare", with_trips("""
SELECT schedule_number, avg(Epkm) AS Epkm FROM trips_basic
WHERE schedule_number IN ('3', '17', '25') GROUP BY 1"""), doubles=["Epkm"])
def q_schedule_compare(inp):
    """Mean EPKM of three selected schedules."""
    return TR.schedule_compare(inp.trips_basic, ["3", "17", "25"])


# ------------------------------------------------------------------ routes
@query("top10_routes_passengers", with_trips(f"""
SELECT route_no, CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_count FROM trips_ext
WHERE route_no IS NOT NULL GROUP BY 1 ORDER BY total_count DESC NULLS LAST, route_no LIMIT {TOP_N}"""))
def q_top10_routes_passengers(inp):
    """Ten routes with the most passengers."""
    return TR.top_routes_by_passengers(inp.trips_extended, TOP_N)


@query("top10_routes_epkm", with_trips(f"""
, r AS (SELECT route_no, avg(Epkm) AS e FROM trips_ext WHERE route_no IS NOT NULL GROUP BY 1)
SELECT route_no, e AS Epkm FROM r ORDER BY e DESC NULLS LAST, route_no LIMIT {TOP_N}"""),
    doubles=["Epkm"])
def q_top10_routes_epkm(inp):
    """Ten routes with the highest mean EPKM."""
    return TR.top_routes_by_epkm(inp.trips_extended, TOP_N)


_ROUTE_STATS = """
, rs AS (SELECT route_no, CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_passengers,
                avg(CAST(total_count AS DOUBLE)) AS avg_passengers, avg(Epkm) AS epkm,
                count(trip_number) AS total_trips
         FROM trips_ext WHERE route_no IS NOT NULL GROUP BY 1)"""


@query("route_scatter", with_trips(_ROUTE_STATS + """
SELECT *, (SELECT avg(CAST(total_count AS DOUBLE)) FROM trips_ext) AS overall_avg_passengers,
       (SELECT avg(Epkm) FROM trips_ext) AS overall_avg_epkm FROM rs"""),
    doubles=["avg_passengers", "epkm", "overall_avg_passengers", "overall_avg_epkm"])
def q_route_scatter(inp):
    """A34 + K10: per-route totals and means with overall means."""
    return TR.route_scatter(inp.trips_extended)


@query("top5_route_stats", with_trips(_ROUTE_STATS + f"""
, a AS (SELECT 'total_passengers' AS ranking, route_no, CAST(total_passengers AS DOUBLE) AS value FROM rs
        ORDER BY total_passengers DESC NULLS LAST, route_no LIMIT 5),
b AS (SELECT 'epkm' AS ranking, route_no, epkm AS value FROM rs
      ORDER BY epkm DESC NULLS LAST, route_no LIMIT 5)
SELECT * FROM a UNION ALL SELECT * FROM b"""), doubles=["value"])
def q_top5_route_stats(inp):
    """Top five routes by total passengers and by mean EPKM."""
    return TR.top5_route_stats(inp.trips_extended, 5)


_TOPN = """
, re AS (SELECT route_no, avg(Epkm) AS avg_epkm, sum(Epkm) AS total_epkm,
                CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_passengers,
                coalesce(sum(travel_distance), 0) AS total_distance
         FROM trips_ext WHERE route_no IS NOT NULL GROUP BY 1)"""


@query("topn_routes_avg_epkm", with_trips(_TOPN + f"""
SELECT * FROM re ORDER BY avg_epkm DESC NULLS LAST, route_no LIMIT {TOP_N}"""),
    doubles=["avg_epkm", "total_epkm", "total_distance"])
def q_topn_routes_avg_epkm(inp):
    """Top-N routes by mean EPKM."""
    return TR.topn_routes(inp.trips_extended, TOP_N, "avg_epkm")


@query("topn_routes_total_epkm", with_trips(_TOPN + f"""
SELECT * FROM re ORDER BY total_epkm DESC NULLS LAST, route_no LIMIT {TOP_N}"""),
    doubles=["avg_epkm", "total_epkm", "total_distance"])
def q_topn_routes_total_epkm(inp):
    """Top-N routes by total (summed) EPKM."""
    return TR.topn_routes(inp.trips_extended, TOP_N, "total_epkm")


# ------------------------------------------------------------------ trends
@query("monthly_passengers", with_trips("""
, per AS (SELECT last_day(CAST(running_date AS DATE)) AS month_end, sum(total_count) AS s,
                 avg(total_count) AS m FROM trips_ext GROUP BY 1),
sp AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)),
                                                  date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end
       FROM per)
SELECT sp.month_end, CAST(coalesce(per.s, 0) AS BIGINT) AS total_passengers, per.m AS avg_per_trip
FROM sp LEFT JOIN per USING (month_end)"""), doubles=["avg_per_trip"])
def q_monthly_passengers(inp):
    """Passengers per month end, empty months kept."""
    return TR.monthly_passengers(inp.trips_extended)


@query("yoy_monthly_passengers", with_trips("""
SELECT CAST(year(running_date) AS BIGINT) AS year, strftime(running_date, '%B') AS month_name,
       CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_passengers
FROM trips_ext GROUP BY 1, 2
HAVING (SELECT count(DISTINCT year(running_date)) FROM trips_ext) > 1"""))
def q_yoy_monthly_passengers(inp):
    """Passengers by (year, month name) when more than one year."""
    return TR.yoy_monthly_passengers(inp.trips_extended)


def _trend_sql(label: str, step: str, spine_expr: str) -> str:
    return with_trips(f"""
, per AS (SELECT {label} AS period, avg(Epkm) AS avg_epkm FROM trips_ext GROUP BY 1),
sp AS (SELECT {spine_expr} AS period FROM per)
SELECT sp.period, per.avg_epkm, (SELECT avg(Epkm) FROM trips_ext) AS system_avg_epkm
FROM sp LEFT JOIN per USING (period)""")


@query("epkm_trend_daily", _trend_sql(
    "CAST(running_date AS DATE)", "1 DAY",
    "CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE)"),
    doubles=["avg_epkm", "system_avg_epkm"])
def q_epkm_trend_daily(inp):
    """Mean EPKM per day, empty days NULL."""
    return TR.epkm_trend(inp.trips_extended, "D")


@query("epkm_trend_weekly", _trend_sql(
    "CAST(date_trunc('week', CAST(running_date AS DATE) - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)", "7 DAY",
    "CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE)"),
    doubles=["avg_epkm", "system_avg_epkm"])
def q_epkm_trend_weekly(inp):
    """Mean EPKM per Tuesday..Monday week (Monday label)."""
    return TR.epkm_trend(inp.trips_extended, "W-MON")


@query("epkm_trend_monthly", _trend_sql(
    "last_day(CAST(running_date AS DATE))", "1 MONTH",
    "last_day(CAST(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), "
    "INTERVAL 1 MONTH)) AS DATE))"),
    doubles=["avg_epkm", "system_avg_epkm"])
def q_epkm_trend_monthly(inp):
    """Mean EPKM per month end, empty months NULL."""
    return TR.epkm_trend(inp.trips_extended, "M")


# ------------------------------------------------------------------ month sheet
@query("daily_passengers", with_trips("""
SELECT running_date, CAST(coalesce(sum(total_passenger), 0) AS BIGINT) AS total_passenger
FROM trips_month GROUP BY 1"""))
def q_daily_passengers(inp):
    """Passengers per date (month sheet)."""
    return TR.daily_totals(inp.trips_monthly, "total_passenger")


@query("daily_revenue", with_trips("""
SELECT running_date, coalesce(sum(total_amount), 0) AS total_amount FROM trips_month GROUP BY 1"""),
    doubles=["total_amount"])
def q_daily_revenue(inp):
    """Revenue per date (month sheet)."""
    return TR.daily_totals(inp.trips_monthly, "total_amount")


@query("month_top5_routes", with_trips("""
SELECT route_no, CAST(coalesce(sum(total_passenger), 0) AS BIGINT) AS total_passenger FROM trips_month
GROUP BY 1 ORDER BY total_passenger DESC NULLS LAST, route_no LIMIT 5"""))
def q_month_top5_routes(inp):
    """A1 on the month sheet ('nan' is an ordinary route key there)."""
    return TR.top_routes_by_passengers(inp.trips_monthly, 5, "total_passenger")


@query("month_bottom5_routes", with_trips("""
SELECT route_no, CAST(coalesce(sum(total_passenger), 0) AS BIGINT) AS total_passenger FROM trips_month
GROUP BY 1 ORDER BY total_passenger ASC NULLS LAST, route_no LIMIT 5"""))
def q_month_bottom5_routes(inp):
    """A2 on the month sheet (ascending)."""
    return TR.top_routes_by_passengers(inp.trips_monthly, 5, "total_passenger", largest=False)


@query("service_avg_epkm", with_trips("""
SELECT color_line, avg(Epkm) AS Epkm FROM trips_month GROUP BY 1 HAVING avg(Epkm) IS NOT NULL"""),
    doubles=["Epkm"])
def q_service_avg_epkm(inp):
    """Mean EPKM-D per service line."""
    return TR.service_avg_epkm(inp.trips_monthly)


_MC = """
, mc AS (SELECT month, CAST(coalesce(sum(total_passenger), 0) AS DOUBLE) AS Passengers,
                coalesce(sum(total_amount), 0) AS Revenue, coalesce(sum(travel_distance), 0) AS Distance,
                avg(Epkm) AS EPKM, CAST(month(min(running_date)) AS BIGINT) AS month_no
         FROM trips_month GROUP BY month)"""


@query("month_comparison", with_trips(_MC + "\nSELECT * FROM mc"),
       doubles=["Passengers", "Revenue", "Distance", "EPKM"])
def q_month_comparison(inp):
    """Per month name totals and mean EPKM with month number."""
    return TR.month_comparison(inp.trips_monthly)


def _mom(c: str, out: str) -> str:
    cur, prev = f"{c}_f", f"lag({c}_f) OVER o"
    return (f"CASE WHEN {prev} <> 0 THEN ({cur} / {prev} - 1) * 100 WHEN {prev} IS NULL THEN NULL "
            f"WHEN {cur} > 0 THEN CAST('inf' AS DOUBLE) WHEN {cur} < 0 THEN CAST('-inf' AS DOUBLE) END AS {out}")


@query("month_over_month", with_trips(_MC + """
, f AS (SELECT *, last_value(Passengers IGNORE NULLS) OVER w AS Passengers_f,
               last_value(Revenue IGNORE NULLS) OVER w AS Revenue_f,
               last_value(Distance IGNORE NULLS) OVER w AS Distance_f,
               last_value(EPKM IGNORE NULLS) OVER w AS EPKM_f
        FROM mc WINDOW w AS (ORDER BY month_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT month, Passengers, Revenue, Distance, EPKM, month_no,
       """ + ", ".join(_mom(c, n) for c, n in (
    ("Passengers", "Passenger_MoM"), ("Revenue", "Revenue_MoM"), ("Distance", "Distance_MoM"), ("EPKM", "EPKM_MoM"))) + """
FROM f WINDOW o AS (ORDER BY month_no)"""),
    doubles=["Passengers", "Revenue", "Distance", "EPKM", "Passenger_MoM", "Revenue_MoM",
             "Distance_MoM", "EPKM_MoM"])
def q_month_over_month(inp):
    """Month-on-month % change of the four month measures."""
    return TR.month_over_month(inp.trips_monthly)


# ------------------------------------------------------------------ statistics
_Z = """
, mom AS (SELECT avg(Epkm) AS mu, stddev_samp(Epkm) AS sd FROM trips_ext),
z AS (SELECT t.*, abs((t.Epkm - m.mu) / CASE WHEN m.sd > 0 THEN m.sd END) AS epkm_zscore
      FROM trips_ext t, mom m)"""
Z_COLS = "running_date, route_no, schedule_number, total_count, total_amount, travel_distance, Epkm, epkm_zscore"


@query("epkm_outliers", with_trips(_Z + f"""
SELECT {Z_COLS} FROM z WHERE epkm_zscore > {Z_THRESHOLD}"""),
    doubles=["total_amount", "travel_distance", "Epkm", "epkm_zscore"])
def q_epkm_outliers(inp):
    """Rows with |z| of EPKM above 3, sorted by |z|."""
    return stats.epkm_outliers(inp.trips_extended, Z_THRESHOLD).select(Z_COLS.split(", "))


@query("epkm_zscores", with_trips(_Z + f"\nSELECT {Z_COLS} FROM z"),
       doubles=["total_amount", "travel_distance", "Epkm", "epkm_zscore"])
def q_epkm_zscores(inp):
    """Every row with its |z| (the context view)."""
    return stats.epkm_zscores(inp.trips_extended).select(Z_COLS.split(", "))


_CORR = ("covar_samp(CAST(total_count AS DOUBLE), total_amount) / "
         "NULLIF(stddev_samp(CAST(total_count AS DOUBLE)) * stddev_samp(total_amount), 0)")


@query("corr_passenger_revenue", with_trips(f"SELECT {_CORR} AS correlation FROM trips_ext"),
       doubles=["correlation"])
def q_corr_passenger_revenue(inp):
    """Pearson correlation of passengers and revenue."""
    return stats.corr_passenger_revenue(inp.trips_extended)


@query("corr_by_service", with_trips(f"""
SELECT service_type, {_CORR} AS correlation FROM trips_ext WHERE service_type IS NOT NULL GROUP BY 1"""),
    doubles=["correlation"])
def q_corr_by_service(inp):
    """Pearson correlation per service type."""
    return stats.corr_by_service(inp.trips_extended)


@query("ols_by_service", with_trips("""
SELECT service_type,
       CASE WHEN var_pop(CAST(total_count AS DOUBLE)) > 0 THEN regr_slope(total_amount, CAST(total_count AS DOUBLE)) END AS slope,
       CASE WHEN var_pop(CAST(total_count AS DOUBLE)) > 0 THEN regr_intercept(total_amount, CAST(total_count AS DOUBLE)) END AS intercept,
       regr_r2(total_amount, CAST(total_count AS DOUBLE)) AS r2,
       CAST(regr_count(total_amount, CAST(total_count AS DOUBLE)) AS BIGINT) AS n
FROM trips_ext WHERE service_type IS NOT NULL GROUP BY 1"""), doubles=["slope", "intercept", "r2"])
def q_ols_by_service(inp):
    """Least-squares revenue ~ passengers per service type."""
    return stats.ols_by_service(inp.trips_extended)


@query("service_epkm_stats", with_trips("""
SELECT service_type, avg(Epkm) AS mean_epkm, quantile_cont(Epkm, 0.5) AS median_epkm,
       quantile_cont(Epkm, 0.95) AS p95_epkm
FROM trips_ext WHERE service_type IS NOT NULL GROUP BY 1"""),
    doubles=["mean_epkm", "median_epkm", "p95_epkm"])
def q_service_epkm_stats(inp):
    """Mean, exact median and exact p95 of EPKM per service."""
    return stats.service_epkm_stats(inp.trips_extended)


@query("service_epkm_distribution", with_trips("""
SELECT service_type, min(Epkm) AS min_epkm, max(Epkm) AS max_epkm, count(Epkm) AS n,
       quantile_cont(Epkm, 0.25) AS q1_epkm, quantile_cont(Epkm, 0.5) AS median_epkm,
       quantile_cont(Epkm, 0.75) AS q3_epkm
FROM trips_ext WHERE service_type IS NOT NULL GROUP BY 1"""),
    doubles=["min_epkm", "max_epkm", "q1_epkm", "median_epkm", "q3_epkm"])
def q_service_epkm_distribution(inp):
    """Five-number summary and count of EPKM per service."""
    return stats.service_epkm_distribution(inp.trips_extended)


# ------------------------------------------------------------------ data quality
@query("trip_clean_quality", with_trips("""
SELECT count(*) AS rows, count(*) FILTER (WHERE running_date IS NOT NULL AND rd IS NULL) AS bad_running_date,
       count(*) FILTER (WHERE trip_number IS NOT NULL AND TRY_CAST(trip_number AS DOUBLE) IS NULL) AS bad_trip_number,
       count(*) FILTER (WHERE running_time IS NOT NULL AND TRY_CAST(running_time AS DOUBLE) IS NULL) AS bad_running_time,
       CAST(0 AS BIGINT) AS bad_total_amount,
       count(*) FILTER (WHERE rd IS NULL OR total_amount IS NULL OR travel_distance IS NULL) AS dropped_rows,
       (SELECT count(*) FROM trips_ext) AS kept_rows, (SELECT sum(total_amount) FROM trips_ext) AS total_revenue
FROM (SELECT t.*, TRY_CAST(t.running_date AS TIMESTAMP) AS rd FROM trips t)"""), doubles=["total_revenue"])
def q_trip_clean_quality(inp):
    """What the drill-down cleaning coerces to NULL and drops, counted by
    the pass that writes the cleaned table."""
    seen = Observation("trips")
    kept = keep_table(clean.clean_trips_extended(inp.trips, counts=seen), "trips_cleaned")
    found = seen.get
    names = ["rows", "bad_running_date", "bad_trip_number", "bad_running_time", "bad_total_amount", "dropped_rows"]
    totals = kept.agg(F.count(F.lit(1)).alias("kept_rows"), F.sum("total_amount").alias("total_revenue"))
    return totals.select(*[F.lit(found[n]).cast("long").alias(n) for n in names], "*")


# ------------------------------------------------------------------ one-pass pages
@query("page_domains", with_trips("""
, g AS (SELECT 'month' AS domain, month AS value, running_date, trip_number FROM trips_ext
        UNION ALL SELECT 'day_of_week', day_of_week, running_date, trip_number FROM trips_ext
        UNION ALL SELECT 'service_type', service_type, running_date, trip_number FROM trips_ext
        UNION ALL SELECT 'route_no', route_no, running_date, trip_number FROM trips_ext
        UNION ALL SELECT 'iso_week', CAST(weekofyear(running_date) AS VARCHAR), running_date, trip_number FROM trips_ext
        UNION ALL SELECT NULL, NULL, running_date, trip_number FROM trips_ext)
SELECT domain, value, count(*) AS rows, CAST(min(running_date) AS DATE) AS first_date,
       CAST(max(running_date) AS DATE) AS last_date, CAST(max(trip_number) AS DOUBLE) AS max_number
FROM g GROUP BY 1, 2"""), doubles=["max_number"])
def q_page_domains(inp):
    """Every selection list of the drill-down page and its bounds in one
    fact read."""
    d = inp.trips_extended.withColumn("iso_week", iso_week(F.col("running_date")))
    return domains.page_domains(d, ["month", "day_of_week", "service_type", "route_no", "iso_week"], "running_date", "trip_number")


@query("dow_service_map", with_trips("""
, g AS (SELECT day_of_week, service_type, avg(CAST(total_count AS DOUBLE)) AS m
        FROM trips_ext WHERE day_of_week IS NOT NULL AND service_type IS NOT NULL GROUP BY 1, 2)
SELECT day_of_week, string_agg(service_type, ',' ORDER BY service_type) AS services,
       max(CASE WHEN service_type = 'ASIA' THEN m END) AS ASIA, max(CASE WHEN service_type = 'EUROPE' THEN m END) AS EUROPE
FROM g GROUP BY 1"""), doubles=["ASIA", "EUROPE"])
def q_dow_service_map(inp):
    """A31 as a map from service to mean passengers by weekday, of which two
    entries are shown as columns."""
    m = TR.dow_service_map(inp.trips_extended)
    keys = m.withColumn("services", F.array_join(F.array_sort(F.map_keys("avg_passengers")), ","))
    return TR.widen(keys, ["ASIA", "EUROPE"])


_MOMENTS = """
, v AS (SELECT service_type, CAST(total_count AS DOUBLE) AS x, total_amount AS y, Epkm AS e FROM trips_ext)
SELECT {key} count(*) AS n, corr(x, y) AS correlation, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
       regr_r2(y, x) AS r2, avg(e) AS mean_epkm, stddev_samp(e) AS sd_epkm
FROM v {group}"""
_MOMENT_DOUBLES = ["correlation", "slope", "intercept", "r2", "mean_epkm", "sd_epkm"]


@query("service_moments", with_trips(_MOMENTS.format(key="service_type,", group="GROUP BY 1")), doubles=_MOMENT_DOUBLES)
def q_service_moments(inp):
    """Correlation, line and EPKM spread of every service, from one
    row of co-moments each."""
    return moments.statistics(moments.service_moments(inp.trips_extended))


@query("overall_moments", with_trips(_MOMENTS.format(key="", group="")), doubles=_MOMENT_DOUBLES)
def q_overall_moments(inp):
    """The same over all trips, from the services' rows merged."""
    return moments.statistics(moments.merge_moments(moments.service_moments(inp.trips_extended)))


# ------------------------------------------------------------------ rollup
def trip_rollup(inp):
    """The cleaned trips as a rollup on the shared folder, loaded in two
    batches (up to 1997, and the later ones appended)."""
    store = rollup.RollupStore(inp.spark, new_path(inp.spark, "trip_rollup"))
    early = F.col("running_date") < F.lit("1998-01-01").cast("timestamp_ntz")
    store.append(rollup.rollup_trips(inp.trips_extended.where(early)), "to-1997")
    store.append(rollup.rollup_trips(inp.trips_extended.where(~early)), "from-1998")
    return store.read()


@query("rollup_trip_kpis", with_trips("""
SELECT count(*) AS total_trips, CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_passengers,
       coalesce(sum(total_amount), 0) AS total_revenue, coalesce(sum(travel_distance), 0) AS total_distance,
       coalesce(avg(running_time), 0) AS avg_running_time, coalesce(avg(Epkm), 0) AS avg_epkm
FROM trips_ext WHERE month IN ('March') AND weekofyear(running_date) IN (10, 11)
  AND service_type IN ('ASIA', 'EUROPE', 'AFRICA')"""),
    doubles=["total_revenue", "total_distance", "avg_running_time", "avg_epkm"])
def q_rollup_trip_kpis(inp):
    """The drill-down KPIs of two ISO weeks of March and three
    services, from the rollup: the filters apply to it as to the trips."""
    spec = filters.CalendarFilter(months=["March"], weeks=[10, 11], services=["ASIA", "EUROPE", "AFRICA"])
    return rollup.kpi_trips(spec.apply(trip_rollup(inp)))


@query("rollup_monthly_revenue", with_trips("""
, agg AS (SELECT month, sum(total_amount) AS total_amount, CAST(sum(total_count) AS BIGINT) AS total_count
          FROM trips_ext WHERE month IN ('March', 'May') GROUP BY month),
months AS (SELECT DISTINCT CAST(month(running_date) AS BIGINT) AS month_no, strftime(running_date, '%B') AS month
           FROM trips_ext)
SELECT m.month_no, m.month, a.total_amount, a.total_count FROM months m LEFT JOIN agg a USING (month)"""),
    doubles=["total_amount"])
def q_rollup_monthly_revenue(inp):
    """Revenue and passengers by month name under a selection, from the rollup."""
    r = trip_rollup(inp)
    return rollup.monthly_revenue(filters.CalendarFilter(months=["March", "May"]).apply(r), months_from=r)


@query("rollup_daily_revenue_in_month", with_trips("""
SELECT CAST(running_date AS DATE) AS running_date, coalesce(sum(total_amount), 0) AS total_amount
FROM trips_ext WHERE month = 'March' GROUP BY 1"""), doubles=["total_amount"])
def q_rollup_daily_revenue_in_month(inp):
    """Revenue per date in March, from the rollup."""
    return rollup.daily_revenue_in_month(trip_rollup(inp), "March")


@query("rollup_dow_pattern", with_trips(f"""
, {_DAYS},
agg AS (SELECT day_of_week, avg(total_amount) AS avg_revenue, avg(CAST(total_count AS DOUBLE)) AS avg_passengers
        FROM trips_ext GROUP BY 1)
SELECT d.day_of_week, CAST(d.day_no AS BIGINT) AS day_no, coalesce(a.avg_revenue, 0) AS avg_revenue,
       coalesce(a.avg_passengers, 0) AS avg_passengers
FROM days d LEFT JOIN agg a USING (day_of_week)"""), doubles=["avg_revenue", "avg_passengers"])
def q_rollup_dow_pattern(inp):
    """Means by weekday, from the rollup."""
    return rollup.dow_pattern(trip_rollup(inp))


@query("rollup_schedule_stats", with_trips(_SCHED + "\nSELECT * FROM ss"),
       doubles=["avg_epkm", "total_revenue", "total_distance"])
def q_rollup_schedule_stats(inp):
    """Schedule means and totals, from the rollup."""
    return rollup.schedule_stats(trip_rollup(inp), MIN_TRIPS)


@query("rollup_top10_routes", with_trips(f"""
SELECT route_no, CAST(coalesce(sum(total_count), 0) AS BIGINT) AS total_count FROM trips_ext
WHERE route_no IS NOT NULL GROUP BY 1 ORDER BY total_count DESC NULLS LAST, route_no LIMIT {TOP_N}"""))
def q_rollup_top10_routes(inp):
    """Ten routes with the most passengers, from the rollup."""
    return rollup.trip_routes_by_passengers(trip_rollup(inp), TOP_N)


@query("rollup_monthly_passengers", with_trips("""
, per AS (SELECT last_day(CAST(running_date AS DATE)) AS month_end, sum(total_count) AS s,
                 avg(total_count) AS m FROM trips_ext GROUP BY 1),
sp AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)),
                                                  date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end
       FROM per)
SELECT sp.month_end, CAST(coalesce(per.s, 0) AS BIGINT) AS total_passengers, per.m AS avg_per_trip
FROM sp LEFT JOIN per USING (month_end)"""), doubles=["avg_per_trip"])
def q_rollup_monthly_passengers(inp):
    """Passengers per month end, from the rollup."""
    return rollup.monthly_passengers(trip_rollup(inp))


@query("rollup_epkm_trend_daily", _trend_sql(
    "CAST(running_date AS DATE)", "1 DAY",
    "CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE)"),
    doubles=["avg_epkm", "system_avg_epkm"])
def q_rollup_epkm_trend_daily(inp):
    """Mean EPKM per day, from the rollup."""
    return rollup.epkm_trend(trip_rollup(inp), "D")


@query("rollup_daily_passengers", with_trips("""
SELECT CAST(running_date AS DATE) AS running_date, CAST(sum(total_count) AS BIGINT) AS total_count
FROM trips_ext GROUP BY 1"""))
def q_rollup_daily_passengers(inp):
    """Passengers per date, from the rollup."""
    return rollup.daily_totals(trip_rollup(inp), "total_count")
