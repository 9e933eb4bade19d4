"""Registered queries over ticket-level facts (the ticket dashboard)."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import domains, enrich, filters, rollup
from ..operators import tickets as T
from ..operators.joins import dedupe_last
from ..operators.ranking import top_k
from ..scratch import keep_table, new_path
from ..session import scratch_path
from .. import schema as S
from ..sources import export_csv_with_count, read_dimension, read_tickets, union_batches
from ..sources.bucketed import save_bucketed
from ..sources.sinks import export_csv
from .catalog import query
from .params import DENSITY_ABOVE, ROUTE, SCORE_BELOW
from .sql_fixtures import with_tickets

KEY_COLS = ["trip_no", "route_no", "schedule_no", "vehicle_no", "ticket_datetime",
            "px_count", "px_total_amount", "travelled_KM", "service_type", "ticket_type"]
KEY_SQL = ", ".join(KEY_COLS)


def _route_df(inp):
    return filters.filter_route(inp.filtered, ROUTE)


def _fleet_df(inp):
    return filters.filter_vehicle_dates(inp.enriched)


# ------------------------------------------------------------------ sources
@query("scan_tickets", with_tickets("SELECT * FROM tickets"),
       doubles=["px_total_amount", "travelled_KM"])
def q_scan_tickets(inp):
    """Ticket facts written as header CSV to the shared scratch folder
    and scanned back with the declared schema."""
    path = export_csv(inp.tickets, scratch_path(inp.spark, "scan_tickets", uuid.uuid4().hex), "tickets", dated=False)
    return read_tickets(inp.spark, path, fmt="csv")


@query("union_batches", with_tickets(f"SELECT {KEY_SQL} FROM enriched"),
       doubles=["px_total_amount", "travelled_KM"])
def q_union_batches(inp):
    """Tickets enriched in two date batches, then bag-unioned; the lookup
    tables are prepared once for both."""
    dims = enrich.prepare_dimensions(inp.ticket_types, inp.service_types, inp.form_four)
    early = F.col("ticket_date") < F.lit("1998-01-01")
    batches = [inp.tickets.where(early), inp.tickets.where(~early | F.col("ticket_date").isNull())]
    return union_batches([enrich.enrich_tickets(b, *dims) for b in batches]).select(KEY_COLS)


@query("export_filtered", with_tickets("""
SELECT trip_no, route_no, schedule_no, vehicle_no, ticket_date, ticket_time, px_count,
       px_total_amount, travelled_KM, service_type, ticket_type,
       count(*) OVER () AS exported_rows
FROM filtered"""), doubles=["px_total_amount", "travelled_KM"])
def q_export_filtered(inp):
    """The globally filtered rows exported as CSV, read back, with
    the exported row count attached."""
    cols = ["trip_no", "route_no", "schedule_no", "vehicle_no", "ticket_date", "ticket_time",
            "px_count", "px_total_amount", "travelled_KM", "service_type", "ticket_type"]
    out = inp.filtered.select(cols)
    path, n = export_csv_with_count(out, scratch_path(inp.spark, "export", uuid.uuid4().hex), "transport_data")
    back = inp.spark.read.option("header", True).schema(out.schema).csv(path)
    return back.withColumn("exported_rows", F.lit(n).cast("long"))


@query("scan_dimension", with_tickets(
    "SELECT schedule_no, route_id, kms FROM ff_last"), doubles=["kms"])
def q_scan_dimension(inp):
    """S3: the route-distance table as several CSV files in row order, scanned
    with the declared schema; of duplicate keys the last row in file order wins."""
    dim = inp.form_four.orderBy("ord").select("schedule_no", "route_id", "kms")
    path = export_csv(dim, scratch_path(inp.spark, "dimension", uuid.uuid4().hex), "form_four", dated=False)
    return dedupe_last(read_dimension(inp.spark, path, S.FORM_FOUR), ["schedule_no", "route_id"], ["kms"])


# ------------------------------------------------------------------ enrichment
@query("lookup_ticket_type", with_tickets(
    "SELECT trip_no, route_no, schedule_no, ticket_type_short_code, ticket_type FROM enriched"))
def q_lookup_ticket_type(inp):
    """Ticket type name by code (last duplicate wins, unmatched NULL)."""
    return enrich.map_ticket_type(inp.tickets, inp.ticket_types).select(
        "trip_no", "route_no", "schedule_no", "ticket_type_short_code", "ticket_type")


@query("lookup_service_type", with_tickets(
    "SELECT trip_no, route_no, schedule_no, bus_service_id, service_type FROM enriched"))
def q_lookup_service_type(inp):
    """Service name by id (last duplicate wins, unmatched NULL)."""
    return enrich.map_service_type(inp.tickets, inp.service_types).select(
        "trip_no", "route_no", "schedule_no", "bus_service_id", "service_type")


@query("override_distance", with_tickets(
    "SELECT trip_no, route_no, schedule_no, raw_km, travelled_KM FROM enriched"),
    doubles=["raw_km", "travelled_KM"])
def q_override_distance(inp):
    """Km from the route-distance table by (schedule, route); a listed
    key with NULL km gives NULL; unlisted keys keep their own km."""
    t = inp.tickets.withColumn("raw_km", F.col("travelled_KM"))
    return enrich.override_distance(t, inp.form_four).select(
        "trip_no", "route_no", "schedule_no", "raw_km", "travelled_KM")


@query("parse_ticket_datetime", with_tickets(
    "SELECT trip_no, route_no, schedule_no, ticket_datetime, ticket_date FROM enriched"))
def q_parse_ticket_datetime(inp):
    """Timestamp from date + time text, and its date part."""
    return enrich.parse_ticket_datetime(inp.tickets).select(
        "trip_no", "route_no", "schedule_no", "ticket_datetime", "ticket_date")


@query("ratio_per_km", with_tickets(
    "SELECT trip_no, route_no, schedule_no, revenue_per_km, passengers_per_km FROM enriched"),
    doubles=["revenue_per_km", "passengers_per_km"])
def q_ratio_per_km(inp):
    """Revenue and passengers per raw km (0 km counts as 1)."""
    return enrich.add_ratios(inp.tickets).select(
        "trip_no", "route_no", "schedule_no", "revenue_per_km", "passengers_per_km")


# ------------------------------------------------------------------ filters
@query("filter_datetime_between", with_tickets(f"""
SELECT {KEY_SQL} FROM enriched
WHERE ticket_datetime BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'"""),
    doubles=["px_total_amount", "travelled_KM"])
def q_filter_datetime_between(inp):
    """rows between two dates, the end date at midnight."""
    return inp.enriched.where(
        filters.datetime_between("ticket_datetime", "1996-01-01", "1996-12-31")).select(KEY_COLS)


@query("filter_global", with_tickets(f"""
SELECT {KEY_SQL} FROM enriched
WHERE ticket_datetime BETWEEN TIMESTAMP '1995-06-01 00:00:00' AND TIMESTAMP '1999-06-30 00:00:00'
  AND service_type IN ('ASIA', 'EUROPE')"""), doubles=["px_total_amount", "travelled_KM"])
def q_filter_global(inp):
    """date range AND service list."""
    return filters.filter_global(inp.enriched, ("1995-06-01", "1999-06-30"),
                                 ["ASIA", "EUROPE"]).select(KEY_COLS)


@query("filter_default_range", with_tickets(f"SELECT {KEY_SQL} FROM filtered"),
       doubles=["px_total_amount", "travelled_KM"])
def q_filter_default_range(inp):
    """F1/F2 default: first date .. last date at midnight, all services."""
    return inp.filtered.select(KEY_COLS)


@query("filter_summary", with_tickets(f"""
SELECT {KEY_SQL} FROM filtered
WHERE ticket_type IN ('NATION_3', 'NATION_7', 'NATION_12') AND route_no IN ('7', '13', '42')"""),
    doubles=["px_total_amount", "travelled_KM"])
def q_filter_summary(inp):
    """ticket-type list AND route list."""
    return filters.filter_summary(inp.filtered, ["NATION_3", "NATION_7", "NATION_12"],
                                  ["7", "13", "42"]).select(KEY_COLS)


@query("filter_route_distance", with_tickets(f"""
SELECT {KEY_SQL} FROM filtered
WHERE route_no = '{ROUTE}' AND travelled_KM >= 20
  AND travelled_KM <= (SELECT CAST(floor(max(travelled_KM)) AS BIGINT) FROM filtered)"""),
    doubles=["px_total_amount", "travelled_KM"])
def q_filter_route_distance(inp):
    """one route, km from 20 up to the truncated maximum."""
    return filters.filter_route_distance(inp.filtered, ROUTE, 20).select(KEY_COLS)


@query("filter_date_inclusive", with_tickets(f"""
SELECT {KEY_SQL} FROM enriched
WHERE vehicle_no = 'V370'
  AND CAST(ticket_datetime AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"""),
    doubles=["px_total_amount", "travelled_KM"])
def q_filter_date_inclusive(inp):
    """One vehicle, inclusive date-level range (whole last day)."""
    return filters.filter_vehicle_dates(inp.enriched, "V370", "1995-01-01",
                                        "1998-12-31").select(KEY_COLS)


# ------------------------------------------------------------------ domains
@query("distinct_domain", with_tickets("SELECT DISTINCT route_no FROM filtered"))
def q_distinct_domain(inp):
    """Distinct routes (sorted, NULL kept as a value)."""
    return domains.distinct_values(inp.filtered, "route_no", sort=True)


@query("domain_bounds", with_tickets("""
SELECT CAST(min(ticket_datetime) AS DATE) AS min_date, CAST(max(ticket_datetime) AS DATE) AS max_date,
       CAST(floor(max(travelled_KM)) AS BIGINT) AS max_km_int
FROM filtered"""))
def q_domain_bounds(inp):
    """First / last date and truncated max km of the filtered tickets."""
    return domains.ticket_bounds(inp.filtered)


# ------------------------------------------------------------------ KPIs
@query("kpi_summary", with_tickets("""
SELECT CAST(coalesce(sum(px_count), 0) AS BIGINT) AS total_passengers,
       coalesce(sum(px_total_amount), 0) AS total_revenue,
       coalesce(sum(travelled_KM), 0) AS total_distance,
       avg(revenue_per_km) AS avg_epkm
FROM filtered"""), doubles=["total_revenue", "total_distance", "avg_epkm"])
def q_kpi_summary(inp):
    """K1: passengers, revenue, mapped km, mean EPKM-A."""
    return T.kpi_summary(inp.filtered)


@query("kpi_route", with_tickets(f"""
SELECT count(DISTINCT trip_no) AS distinct_trips,
       CAST(coalesce(sum(px_count), 0) AS BIGINT) AS total_passengers,
       coalesce(sum(px_total_amount), 0) AS total_revenue
FROM filtered WHERE route_no = '{ROUTE}'"""), doubles=["total_revenue"])
def q_kpi_route(inp):
    """K2: distinct trips, passengers and revenue of one route."""
    return T.kpi_route(_route_df(inp))


@query("kpi_fleet", with_tickets("""
, fleet AS (
  SELECT * FROM enriched
  WHERE CAST(ticket_datetime AS DATE) BETWEEN (SELECT CAST(min(ticket_datetime) AS DATE) FROM enriched)
                                         AND (SELECT CAST(max(ticket_datetime) AS DATE) FROM enriched))
SELECT coalesce(sum(travelled_KM), 0) AS total_distance,
       CAST(coalesce(sum(trip_no), 0) AS BIGINT) AS sum_trip_no,
       count(DISTINCT trip_no) AS distinct_trips,
       CAST(count(DISTINCT vehicle_no) + max(CASE WHEN vehicle_no IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS active_vehicles,
       (SELECT count(DISTINCT vehicle_no) FROM enriched) AS total_vehicles,
       (SELECT count(DISTINCT vehicle_no) FROM enriched)
         - CAST(count(DISTINCT vehicle_no) + max(CASE WHEN vehicle_no IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS idle_vehicles
FROM fleet"""), doubles=["total_distance"])
def q_kpi_fleet(inp):
    """K3/K4: km, sum of trip ids, distinct trips, active / total / idle
    vehicles over the whole (date-range filtered) ticket table."""
    return T.kpi_fleet(_fleet_df(inp), inp.enriched)


@query("kpi_optimization", with_tickets("""
, opt AS (
  SELECT * FROM filtered
  WHERE travelled_KM >= 0 AND travelled_KM <= (SELECT CAST(floor(max(travelled_KM)) AS BIGINT) FROM filtered)),
k AS (SELECT avg(passengers_per_km) AS p, avg(revenue_per_km) AS r FROM opt)
SELECT p AS avg_passengers_per_km, r AS avg_revenue_per_km,
       CASE WHEN p = 0 THEN 0.0 ELSE r / p END AS efficiency_score FROM k"""),
    doubles=["avg_passengers_per_km", "avg_revenue_per_km", "efficiency_score"])
def q_kpi_optimization(inp):
    """K5: mean passengers/km, mean revenue/km and efficiency score over the
    optimisation selection (all routes, km 0 .. truncated max)."""
    return T.default_optimization(inp.filtered)


@query("sustainability_summary", with_tickets("""
, k AS (
  SELECT coalesce(sum(CASE WHEN service_type = 'EV INTERSTATE' THEN travelled_KM END), 0) AS ev_km,
         coalesce(sum(CASE WHEN service_type = 'MANUAL LOCAL INTERSTATE' THEN travelled_KM END), 0) AS diesel_km,
         coalesce(sum(travelled_KM), 0) AS all_km
  FROM filtered)
SELECT ev_km, diesel_km, all_km, diesel_km * 0.3 AS co2_emitted,
       all_km * 0.3 - diesel_km * 0.3 AS co2_saved FROM k"""),
    doubles=["ev_km", "diesel_km", "all_km", "co2_emitted", "co2_saved"])
def q_sustainability_summary(inp):
    """EV, diesel and total km with CO2 emitted and saved."""
    return T.sustainability_summary(inp.filtered, "All")


@query("sustainability_ev_only", with_tickets("""
, k AS (
  SELECT coalesce(sum(CASE WHEN service_type = 'EV INTERSTATE' THEN travelled_KM END), 0) AS ev_km,
         coalesce(sum(CASE WHEN service_type = 'MANUAL LOCAL INTERSTATE' THEN travelled_KM END), 0) AS diesel_km,
         coalesce(sum(travelled_KM), 0) AS all_km
  FROM filtered WHERE service_type = 'EV INTERSTATE')
SELECT ev_km, diesel_km, all_km, diesel_km * 0.3 AS co2_emitted,
       all_km * 0.3 - diesel_km * 0.3 AS co2_saved FROM k"""),
    doubles=["ev_km", "diesel_km", "all_km", "co2_emitted", "co2_saved"])
def q_sustainability_ev_only(inp):
    """K9 with the bus-type selector on EV."""
    return T.sustainability_summary(inp.filtered, T.EV)


# ------------------------------------------------------------------ rankings
_ROUTE_PX = """
, rp AS (SELECT route_no, CAST(coalesce(sum(px_count), 0) AS BIGINT) AS passengers
         FROM filtered WHERE route_no IS NOT NULL GROUP BY route_no)"""


@query("top5_routes_passengers", with_tickets(_ROUTE_PX + """
SELECT route_no, passengers FROM rp ORDER BY passengers DESC NULLS LAST, route_no LIMIT 5"""))
def q_top5_routes_passengers(inp):
    """A1: five routes with the most passengers."""
    return T.top_routes_by_passengers(inp.filtered, 5)


@query("bottom5_routes_passengers", with_tickets(_ROUTE_PX + """
SELECT route_no, passengers FROM rp ORDER BY passengers ASC NULLS LAST, route_no LIMIT 5"""))
def q_bottom5_routes_passengers(inp):
    """A2: five routes with the fewest passengers."""
    return T.bottom_routes_by_passengers(inp.filtered, 5)


_DAILY = """
, per_day AS (SELECT CAST(ticket_datetime AS DATE) AS day, sum(px_total_amount) AS revenue
              FROM filtered WHERE ticket_datetime IS NOT NULL GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM per_day),
daily AS (SELECT s.day, coalesce(p.revenue, 0) AS revenue FROM spine s LEFT JOIN per_day p USING (day))"""


@query("daily_revenue_filled", with_tickets(_DAILY + "\nSELECT day, revenue FROM daily"),
       doubles=["revenue"])
def q_daily_revenue_filled(inp):
    """A3: revenue per calendar day with empty days as 0."""
    return T.daily_revenue_filled(inp.filtered)


@query("peak_days", with_tickets(_DAILY + f"""
SELECT day, revenue FROM daily ORDER BY revenue DESC NULLS LAST, day LIMIT 3"""),
    doubles=["revenue"])
def q_peak_days(inp):
    """A4: three highest-revenue days."""
    return top_k(T.daily_revenue_filled(inp.filtered), "revenue", "day", 3)


_SCHED = f"""
, sched AS (
  SELECT schedule_no, coalesce(sum(px_total_amount), 0) AS revenue, avg(travelled_KM) AS mean_km,
         count(DISTINCT trip_no) AS trips
  FROM filtered WHERE route_no = '{ROUTE}' AND schedule_no IS NOT NULL GROUP BY schedule_no),
eff AS (SELECT *, CASE WHEN mean_km <> 0 THEN revenue / mean_km WHEN mean_km IS NULL THEN NULL
                      WHEN revenue > 0 THEN CAST('inf' AS DOUBLE) WHEN revenue < 0 THEN CAST('-inf' AS DOUBLE) END AS epkm
        FROM sched)"""


@query("schedule_efficiency", with_tickets(_SCHED + "\nSELECT * FROM eff"),
       doubles=["revenue", "mean_km", "epkm"])
def q_schedule_efficiency(inp):
    """A5: per schedule of one route: revenue, mean km, trips, EPKM-E."""
    return T.schedule_efficiency(_route_df(inp))


@query("top3_schedules", with_tickets(_SCHED + f"""
SELECT * FROM eff ORDER BY epkm DESC NULLS LAST, schedule_no LIMIT 3"""),
    doubles=["revenue", "mean_km", "epkm"])
def q_top3_schedules(inp):
    """The three schedules of highest EPKM-E on one route."""
    return T.top_schedules(_route_df(inp), 3)


_TRIPS = f"""
, ts AS (
  SELECT trip_no, coalesce(sum(px_total_amount), 0) AS revenue, avg(travelled_KM) AS mean_km,
         CAST(coalesce(sum(px_count), 0) AS BIGINT) AS passengers
  FROM filtered WHERE route_no = '{ROUTE}' AND trip_no IS NOT NULL GROUP BY trip_no)"""


@query("trip_stats", with_tickets(_TRIPS + "\nSELECT * FROM ts"), doubles=["revenue", "mean_km"])
def q_trip_stats(inp):
    """Per trip of one route: revenue, mean km, passengers."""
    return T.trip_stats(_route_df(inp))


@query("leaking_trips", with_tickets(_TRIPS + """
SELECT * FROM ts WHERE revenue < (SELECT avg(revenue) FROM ts) * 0.7"""),
    doubles=["revenue", "mean_km"])
def q_leaking_trips(inp):
    """A8 (all): trips of one route below 0.7 x the mean trip revenue."""
    return T.leaking_trips(_route_df(inp))


@query("revenue_leakage", with_tickets(_TRIPS + f"""
SELECT * FROM ts WHERE revenue < (SELECT avg(revenue) FROM ts) * 0.7
ORDER BY revenue ASC NULLS LAST, trip_no LIMIT 3"""), doubles=["revenue", "mean_km"])
def q_revenue_leakage(inp):
    """The three lowest-revenue leaking trips."""
    return top_k(T.leaking_trips(_route_df(inp)), "revenue", "trip_no", 3, largest=False)


_OPT = """
, opt AS (
  SELECT * FROM filtered
  WHERE travelled_KM >= 0 AND travelled_KM <= (SELECT CAST(floor(max(travelled_KM)) AS BIGINT) FROM filtered)),
ro AS (SELECT route_no, avg(passengers_per_km) AS passengers_per_km, avg(revenue_per_km) AS revenue_per_km
       FROM opt WHERE route_no IS NOT NULL GROUP BY route_no),
score AS (SELECT route_no, CASE WHEN passengers_per_km = 0 THEN 0.0
                                ELSE revenue_per_km / passengers_per_km END AS efficiency_score FROM ro)"""


@query("route_density", with_tickets(_OPT + "\nSELECT route_no, passengers_per_km FROM ro"),
       doubles=["passengers_per_km"])
def q_route_density(inp):
    """Mean passengers per km by route."""
    return T.route_density(inp.filtered, default_selection=True)


@query("high_density_routes", with_tickets(_OPT + f"""
SELECT route_no, passengers_per_km FROM ro WHERE passengers_per_km > {DENSITY_ABOVE}"""),
    doubles=["passengers_per_km"])
def q_high_density_routes(inp):
    """A9 alert: routes above the density threshold."""
    return T.high_density_routes(inp.filtered, DENSITY_ABOVE, default_selection=True)


@query("route_revenue_efficiency", with_tickets(_OPT + "\nSELECT route_no, revenue_per_km FROM ro"),
       doubles=["revenue_per_km"])
def q_route_revenue_efficiency(inp):
    """A10: mean revenue per km by route."""
    return T.route_revenue_efficiency(inp.filtered, default_selection=True)


@query("route_efficiency", with_tickets(_OPT + "\nSELECT route_no, efficiency_score FROM score"),
       doubles=["efficiency_score"])
def q_route_efficiency(inp):
    """Efficiency score (mean rev/km over mean px/km) by route."""
    return T.route_efficiency(inp.filtered, default_selection=True)


@query("low_efficiency_routes", with_tickets(_OPT + f"""
SELECT route_no, efficiency_score FROM score WHERE efficiency_score < {SCORE_BELOW}"""),
    doubles=["efficiency_score"])
def q_low_efficiency_routes(inp):
    """A11 alert: routes scoring below the threshold."""
    return T.low_efficiency_routes(inp.filtered, SCORE_BELOW, default_selection=True)


_FLEET = """
, fleet AS (
  SELECT * FROM enriched
  WHERE CAST(ticket_datetime AS DATE) BETWEEN (SELECT CAST(min(ticket_datetime) AS DATE) FROM enriched)
                                         AND (SELECT CAST(max(ticket_datetime) AS DATE) FROM enriched)),
tpv AS (SELECT vehicle_no, count(DISTINCT trip_no) AS trips FROM fleet
        WHERE vehicle_no IS NOT NULL GROUP BY vehicle_no)"""


@query("trips_per_vehicle", with_tickets(_FLEET + "\nSELECT * FROM tpv"))
def q_trips_per_vehicle(inp):
    """Distinct trips per vehicle."""
    return T.trips_per_vehicle(_fleet_df(inp))


@query("underutilized_vehicles", with_tickets(_FLEET + """
SELECT * FROM tpv WHERE trips < (SELECT avg(trips) FROM tpv) * 0.7"""))
def q_underutilized_vehicles(inp):
    """Vehicles under 0.7 x the mean trips per vehicle."""
    return T.underutilized_vehicles(_fleet_df(inp))


@query("overused_vehicles", with_tickets(_FLEET + """
SELECT * FROM tpv WHERE trips > (SELECT avg(trips) FROM tpv) * 1.3"""))
def q_overused_vehicles(inp):
    """Vehicles over 1.3 x the mean trips per vehicle."""
    return T.overused_vehicles(_fleet_df(inp))


@query("monthly_distance", with_tickets(_FLEET + """
SELECT CAST(date_trunc('month', ticket_datetime) AS DATE) AS month_start,
       coalesce(sum(travelled_KM), 0) AS distance
FROM fleet WHERE ticket_datetime IS NOT NULL GROUP BY 1"""), doubles=["distance"])
def q_monthly_distance(inp):
    """Km per calendar month (no empty months)."""
    return T.monthly_distance(_fleet_df(inp))


@query("top3_ev_routes", with_tickets(f"""
, ev AS (SELECT route_no, coalesce(sum(travelled_KM), 0) AS ev_km FROM filtered
         WHERE service_type = 'EV INTERSTATE' AND route_no IS NOT NULL GROUP BY route_no)
SELECT * FROM ev ORDER BY ev_km DESC NULLS LAST, route_no LIMIT 3"""), doubles=["ev_km"])
def q_top3_ev_routes(inp):
    """Three routes with the most EV km."""
    return T.top_ev_routes(inp.filtered, 3)


# ------------------------------------------------------------------ data quality
@query("ticket_scan_quality", with_tickets("""
, torn AS (SELECT *, trip_no % 211 = 0 AS torn, trip_no % 53 = 0 AS bad_count, trip_no % 61 = 0 AS bad_amount,
                  route_id % 17 = 0 AS no_km FROM tickets)
SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE torn) AS BIGINT) AS torn_lines,
       count(*) FILTER (WHERE NOT torn AND bad_count) AS bad_px_count,
       count(*) FILTER (WHERE NOT torn AND bad_amount) AS bad_px_total_amount,
       CAST(0 AS BIGINT) AS bad_travelled_KM,
       count(*) FILTER (WHERE torn OR bad_count OR bad_amount) AS malformed_rows,
       count(*) FILTER (WHERE torn OR bad_count OR bad_amount) AS rescued_rows,
       CAST(sum(CASE WHEN NOT torn AND NOT bad_count THEN px_count END) AS BIGINT) AS total_passengers,
       sum(CASE WHEN NOT torn AND NOT bad_amount THEN px_total_amount END) AS total_revenue,
       sum(CASE WHEN NOT torn AND NOT no_km THEN travelled_KM END) AS total_distance
FROM torn"""), doubles=["total_revenue", "total_distance"])
def q_ticket_scan_quality(inp):
    """Ticket lines with text among the numbers, empty fields and lines cut
    off after three fields, scanned once: what is malformed is counted by the scan
    that writes the typed table, and kept as text beside it."""
    t = inp.tickets
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t.columns]
    at = {c: i for i, c in enumerate(t.columns)}
    fields[at["px_count"]] = F.when(F.col("trip_no") % 53 == 0, F.lit("n/a")).otherwise(fields[at["px_count"]])
    fields[at["px_total_amount"]] = F.when(F.col("trip_no") % 61 == 0, F.lit("12.5x")).otherwise(fields[at["px_total_amount"]])
    fields[at["travelled_KM"]] = F.when(F.col("route_id") % 17 == 0, F.lit("")).otherwise(fields[at["travelled_KM"]])
    whole, cut = F.concat_ws(",", *fields), F.concat_ws(",", *fields[:3])
    path = new_path(inp.spark, "ticket_lines")
    t.select(F.when(F.col("trip_no") % 211 == 0, cut).otherwise(whole).alias("value")).write.text(path)
    seen = Observation("tickets")
    typed = keep_table(read_tickets(inp.spark, path, header=False, counts=seen, rescued="rescued"), "typed_tickets")
    found = seen.get
    totals = typed.agg(F.count("rescued").alias("rescued_rows"), F.sum("px_count").alias("total_passengers"),
                       F.sum("px_total_amount").alias("total_revenue"), F.sum("travelled_KM").alias("total_distance"))
    names = ["rows", "torn_lines", "bad_px_count", "bad_px_total_amount", "bad_travelled_KM", "malformed_rows"]
    return totals.select(*[F.lit(found[n]).cast("long").alias(n) for n in names], "*")


# ------------------------------------------------------------------ prepared tables
@query("override_distance_bucketed", with_tickets(
    "SELECT trip_no, route_no, schedule_no, raw_km, travelled_KM FROM enriched"),
    doubles=["raw_km", "travelled_KM"])
def q_override_distance_bucketed(inp):
    """D3/J2 over tables bucketed on (schedule, route): tickets and route
    distances prepared once, joined without an exchange."""
    keys = ["schedule_no", "route_id"]
    t = inp.tickets.select("trip_no", "route_no", *keys, "travelled_KM", F.col("travelled_KM").alias("raw_km"))
    facts = save_bucketed(t, "tickets", keys, 8)
    dim = save_bucketed(dedupe_last(inp.form_four, keys, ["kms"]), "form_four", keys, 8)
    return enrich.override_distance(facts, dim).select("trip_no", "route_no", "schedule_no", "raw_km", "travelled_KM")


def ticket_rollup(inp):
    """The enriched tickets as a rollup on the shared folder, loaded in two
    batches (up to 1997, and the later ones appended)."""
    store = rollup.RollupStore(inp.spark, new_path(inp.spark, "ticket_rollup"))
    early = F.coalesce(F.col("ticket_datetime") < F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(True))
    store.append(rollup.rollup_tickets(inp.enriched.where(early)), "to-1997")
    store.append(rollup.rollup_tickets(inp.enriched.where(~early)), "from-1998")
    return store.read()


@query("rollup_kpi_summary", with_tickets("""
SELECT CAST(coalesce(sum(px_count), 0) AS BIGINT) AS total_passengers,
       coalesce(sum(px_total_amount), 0) AS total_revenue,
       coalesce(sum(travelled_KM), 0) AS total_distance, avg(revenue_per_km) AS avg_epkm
FROM filtered"""), doubles=["total_revenue", "total_distance", "avg_epkm"])
def q_rollup_kpi_summary(inp):
    """The summary KPIs under the default range, from the rollup."""
    return rollup.kpi_summary(rollup.in_range(ticket_rollup(inp)))


@query("rollup_filtered_kpis", with_tickets("""
SELECT CAST(coalesce(sum(px_count), 0) AS BIGINT) AS total_passengers,
       coalesce(sum(px_total_amount), 0) AS total_revenue,
       coalesce(sum(travelled_KM), 0) AS total_distance, avg(revenue_per_km) AS avg_epkm
FROM enriched
WHERE ticket_datetime BETWEEN TIMESTAMP '1995-06-01 00:00:00' AND TIMESTAMP '1999-06-30 00:00:00'
  AND service_type IN ('ASIA', 'EUROPE')"""), doubles=["total_revenue", "total_distance", "avg_epkm"])
def q_rollup_filtered_kpis(inp):
    """The same under a date range and a service list."""
    r = rollup.in_range(ticket_rollup(inp), "1995-06-01", "1999-06-30")
    return rollup.kpi_summary(r.where(F.col("service_type").isin("ASIA", "EUROPE")))


@query("rollup_routes", with_tickets(_ROUTE_PX + """
SELECT route_no, passengers FROM rp ORDER BY passengers DESC NULLS LAST, route_no LIMIT 5"""))
def q_rollup_routes(inp):
    """Five routes with the most passengers, from the rollup."""
    return rollup.route_passengers(rollup.in_range(ticket_rollup(inp)), 5)


@query("rollup_daily_revenue", with_tickets(_DAILY + "\nSELECT day, revenue FROM daily"), doubles=["revenue"])
def q_rollup_daily_revenue(inp):
    """Revenue per calendar day, from the rollup."""
    return rollup.daily_revenue(rollup.in_range(ticket_rollup(inp)))


@query("rollup_peak_days", with_tickets(_DAILY + """
SELECT day, revenue FROM daily ORDER BY revenue DESC NULLS LAST, day LIMIT 3"""), doubles=["revenue"])
def q_rollup_peak_days(inp):
    """Three highest-revenue days, from the rollup."""
    return rollup.peak_days(rollup.in_range(ticket_rollup(inp)))


@query("rollup_monthly_distance", with_tickets(_FLEET + """
SELECT CAST(date_trunc('month', ticket_datetime) AS DATE) AS month_start, coalesce(sum(travelled_KM), 0) AS distance
FROM fleet WHERE ticket_datetime IS NOT NULL GROUP BY 1"""), doubles=["distance"])
def q_rollup_monthly_distance(inp):
    """Km per calendar month, from the rollup."""
    return rollup.monthly_distance(ticket_rollup(inp))


@query("rollup_sustainability", with_tickets("""
, k AS (
  SELECT coalesce(sum(CASE WHEN service_type = 'EV INTERSTATE' THEN travelled_KM END), 0) AS ev_km,
         coalesce(sum(CASE WHEN service_type = 'MANUAL LOCAL INTERSTATE' THEN travelled_KM END), 0) AS diesel_km,
         coalesce(sum(travelled_KM), 0) AS all_km
  FROM filtered)
SELECT ev_km, diesel_km, all_km, diesel_km * 0.3 AS co2_emitted, all_km * 0.3 - diesel_km * 0.3 AS co2_saved FROM k"""),
    doubles=["ev_km", "diesel_km", "all_km", "co2_emitted", "co2_saved"])
def q_rollup_sustainability(inp):
    """EV, diesel and all km with CO2, from the rollup."""
    return rollup.sustainability(rollup.in_range(ticket_rollup(inp)))


@query("rollup_top_ev_routes", with_tickets("""
, ev AS (SELECT route_no, coalesce(sum(travelled_KM), 0) AS ev_km FROM filtered
         WHERE service_type = 'EV INTERSTATE' AND route_no IS NOT NULL GROUP BY route_no)
SELECT * FROM ev ORDER BY ev_km DESC NULLS LAST, route_no LIMIT 3"""), doubles=["ev_km"])
def q_rollup_top_ev_routes(inp):
    """Three routes with the most EV km, from the rollup."""
    return rollup.top_ev_routes(rollup.in_range(ticket_rollup(inp)))
