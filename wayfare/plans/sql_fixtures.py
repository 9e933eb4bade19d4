"""DuckDB text of the fixture views and cleaned tables used by the oracle.

The oracle is an independent restatement of each query in SQL over the same
parquet tables; these common table expressions bind the driver tables to
the transit schemas exactly as ``wayfare.sources.fixtures`` does and restate
the cleaning rules in SQL.
"""

TICKETS = """
tickets AS (
  SELECT CAST(c.c_nationkey AS INTEGER) AS ticket_type_short_code,
         CAST(n.n_regionkey AS INTEGER) AS bus_service_id,
         strftime(l.l_shipdate, '%Y-%m-%d') AS ticket_date,
         lpad(CAST(((l.l_orderkey * 7 + l.l_linenumber * 131) % 1440) // 60 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(((l.l_orderkey * 7 + l.l_linenumber * 131) % 1440) % 60 AS VARCHAR), 2, '0') || ':00' AS ticket_time,
         l.l_extendedprice AS px_total_amount,
         CAST(l.l_quantity AS BIGINT) AS px_count,
         round(l.l_discount * 1000) AS travelled_KM,
         CAST(l.l_partkey % 40 AS VARCHAR) AS schedule_no,
         l.l_suppkey AS route_id,
         CAST(l.l_suppkey AS VARCHAR) AS route_no,
         l.l_orderkey AS trip_no,
         'V' || CAST(o.o_custkey AS VARCHAR) AS vehicle_no
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey),
ticket_type AS (
  SELECT CAST(n_nationkey AS INTEGER) AS ticket_type_id, n_name AS ticket_type_name, n_nationkey AS ord FROM nation),
service_type AS (
  SELECT CAST(r_regionkey AS INTEGER) AS service_type_id, r_name AS service_type_name, r_regionkey AS ord
  FROM region WHERE r_regionkey <= 3
  UNION ALL SELECT 0, 'EV INTERSTATE', 10
  UNION ALL SELECT 1, 'MANUAL LOCAL INTERSTATE', 11),
form_four AS (
  SELECT CAST(l_partkey % 40 AS VARCHAR) AS schedule_no, l_suppkey AS route_id,
         CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS kms,
         l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3
  FROM lineitem WHERE l_returnflag = 'R'),
tt_last AS (
  SELECT ticket_type_id, ticket_type_name FROM ticket_type
  QUALIFY row_number() OVER (PARTITION BY ticket_type_id ORDER BY ord DESC) = 1),
st_last AS (
  SELECT service_type_id, service_type_name FROM service_type
  QUALIFY row_number() OVER (PARTITION BY service_type_id ORDER BY ord DESC) = 1),
ff_last AS (
  SELECT schedule_no, route_id, kms, TRUE AS matched FROM form_four
  QUALIFY row_number() OVER (PARTITION BY schedule_no, route_id ORDER BY o1 DESC, o2 DESC, o3 DESC) = 1),
enriched AS (
  SELECT t.ticket_type_short_code, t.bus_service_id, t.ticket_time, t.px_total_amount, t.px_count,
         t.schedule_no, t.route_id, t.route_no, t.trip_no, t.vehicle_no,
         tt.ticket_type_name AS ticket_type,
         st.service_type_name AS service_type,
         strptime(t.ticket_date || ' ' || t.ticket_time, '%Y-%m-%d %H:%M:%S') AS ticket_datetime,
         CAST(strptime(t.ticket_date || ' ' || t.ticket_time, '%Y-%m-%d %H:%M:%S') AS DATE) AS ticket_date,
         t.px_total_amount / CASE WHEN t.travelled_KM = 0 THEN 1.0 ELSE t.travelled_KM END AS revenue_per_km,
         CAST(t.px_count AS DOUBLE) / CASE WHEN t.travelled_KM = 0 THEN 1.0 ELSE t.travelled_KM END AS passengers_per_km,
         t.travelled_KM AS raw_km,
         CASE WHEN ff.matched THEN ff.kms ELSE t.travelled_KM END AS travelled_KM
  FROM tickets t
  LEFT JOIN tt_last tt ON t.ticket_type_short_code = tt.ticket_type_id
  LEFT JOIN st_last st ON t.bus_service_id = st.service_type_id
  LEFT JOIN ff_last ff ON t.schedule_no = ff.schedule_no AND t.route_id = ff.route_id),
bounds AS (
  SELECT CAST(min(ticket_datetime) AS DATE) AS d0, CAST(max(ticket_datetime) AS DATE) AS d1 FROM enriched),
filtered AS (
  SELECT e.* FROM enriched e
  WHERE e.ticket_datetime BETWEEN (SELECT CAST(d0 AS TIMESTAMP) FROM bounds)
                              AND (SELECT CAST(d1 AS TIMESTAMP) FROM bounds))
"""

_TRIP_SELECT = """
  SELECT {date_expr} AS running_date,
         CASE WHEN n.n_regionkey = 4 THEN NULL ELSE r.r_name END AS color_line,
         CASE WHEN l.l_suppkey % 50 = 13 THEN NULL ELSE CAST(l.l_suppkey AS VARCHAR) END AS route_no,
         CAST(l.l_partkey % 40 AS VARCHAR) AS schedule_number,
         CASE WHEN l.l_orderkey % 89 = 0 THEN 'x' ELSE CAST(l.l_linenumber AS VARCHAR) END AS trip_number,
         l.l_extendedprice AS total_amount,
         CASE WHEN l.l_partkey % 83 = 0 THEN NULL ELSE round(l.l_discount * 1000) END AS travel_distance,
         CASE WHEN l.l_partkey % 79 = 0 THEN NULL ELSE CAST(l.l_quantity AS BIGINT) END AS {count_name},
         lpad(CAST(CAST(l.l_quantity AS INTEGER) // 2 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(l.l_orderkey % 60 AS VARCHAR), 2, '0') || ':00' AS running_time
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""

_TRIPS_RAW = _TRIP_SELECT.format(
    date_expr="CASE WHEN l.l_orderkey % 97 = 0 THEN 'bad' ELSE strftime(l.l_shipdate, '%Y-%m-%d') END",
    count_name="total_count")
_TRIPS_M_RAW = _TRIP_SELECT.format(
    date_expr="strftime(l.l_shipdate, '%Y-%m-%d')", count_name="total_passenger")

TRIPS = "trips AS (" + _TRIPS_RAW + "),\ntrips_m_raw AS (" + _TRIPS_M_RAW + "),\n" + """
trips_dated AS (
  SELECT TRY_CAST(running_date AS TIMESTAMP) AS rd, * EXCLUDE (running_date) FROM trips),
trips_basic AS (
  SELECT rd AS running_date, strftime(rd, '%B') AS month, dayname(rd) AS day_of_week,
         color_line, color_line AS service_type, route_no, schedule_number,
         TRY_CAST(trip_number AS DOUBLE) AS trip_number, total_amount, travel_distance,
         round_even(coalesce(total_amount / NULLIF(travel_distance, 0), 0) * 100, 0) / 100 AS Epkm,
         coalesce(CAST(total_count AS DOUBLE), 0) AS total_count, running_time
  FROM trips_dated
  WHERE rd IS NOT NULL AND total_amount IS NOT NULL AND travel_distance IS NOT NULL
    AND TRY_CAST(trip_number AS DOUBLE) IS NOT NULL),
trips_ext AS (
  SELECT rd AS running_date, strftime(rd, '%B') AS month, dayname(rd) AS day_of_week,
         color_line, color_line AS service_type, route_no, schedule_number,
         coalesce(CASE WHEN TRY_CAST(trip_number AS DOUBLE) = floor(TRY_CAST(trip_number AS DOUBLE))
                       THEN CAST(TRY_CAST(trip_number AS DOUBLE) AS BIGINT) END, 0) AS trip_number,
         total_amount, travel_distance,
         round_even(coalesce(total_amount / NULLIF(travel_distance + 1e-9, 0), 0) * 100, 0) / 100 AS Epkm,
         coalesce(total_count, 0) AS total_count,
         TRY_CAST(running_time AS DOUBLE) AS running_time
  FROM trips_dated
  WHERE rd IS NOT NULL AND total_amount IS NOT NULL AND travel_distance IS NOT NULL),
trips_month AS (
  SELECT CAST(running_date AS DATE) AS running_date,
         TRY_CAST(split_part(running_time, ':', 1) AS DOUBLE)
           + TRY_CAST(split_part(running_time, ':', 2) AS DOUBLE) / 60.0
           + TRY_CAST(split_part(running_time, ':', 3) AS DOUBLE) / 3600.0 AS running_time,
         coalesce(color_line, 'nan') AS color_line,
         coalesce(route_no, 'nan') AS route_no,
         coalesce(schedule_number, 'nan') AS schedule_number,
         trip_number, total_amount, total_passenger,
         NULLIF(travel_distance, 0) AS travel_distance,
         coalesce(total_amount / NULLIF(travel_distance, 0), 0) AS Epkm,
         dayname(CAST(running_date AS DATE)) AS day_of_week,
         strftime(CAST(running_date AS DATE), '%B') AS month
  FROM trips_m_raw)
"""


def with_tickets(body: str) -> str:
    return "WITH " + TICKETS.strip() + "\n" + body.strip()


def with_trips(body: str) -> str:
    return "WITH " + TRIPS.strip() + "\n" + body.strip()
