"""Declared schemas of the logical tables (never inferred)."""

from pyspark.sql import types as T

TICKETS = T.StructType([
    T.StructField("ticket_type_short_code", T.IntegerType()),
    T.StructField("bus_service_id", T.IntegerType()),
    T.StructField("ticket_date", T.StringType()),
    T.StructField("ticket_time", T.StringType()),
    T.StructField("px_total_amount", T.DoubleType()),
    T.StructField("px_count", T.LongType()),
    T.StructField("travelled_KM", T.DoubleType()),
    T.StructField("schedule_no", T.StringType()),
    T.StructField("route_id", T.LongType()),
    T.StructField("route_no", T.StringType()),
    T.StructField("trip_no", T.LongType()),
    T.StructField("vehicle_no", T.StringType()),
])

TICKET_TYPE = T.StructType([
    T.StructField("ticket_type_id", T.IntegerType()),
    T.StructField("ticket_type_name", T.StringType()),
])

SERVICE_TYPE = T.StructType([
    T.StructField("service_type_id", T.IntegerType()),
    T.StructField("service_type_name", T.StringType()),
])

FORM_FOUR = T.StructType([
    T.StructField("schedule_no", T.StringType()),
    T.StructField("route_id", T.LongType()),
    T.StructField("kms", T.DoubleType()),
])

# Raw trip sheet: everything that the dashboards coerce arrives as text or
# loosely typed numbers.
TRIPS = T.StructType([
    T.StructField("running_date", T.StringType()),
    T.StructField("color_line", T.StringType()),
    T.StructField("route_no", T.StringType()),
    T.StructField("schedule_number", T.StringType()),
    T.StructField("trip_number", T.StringType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("travel_distance", T.DoubleType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("running_time", T.StringType()),
])

# The month-comparison sheet names the passenger column differently.
TRIPS_MONTHLY = T.StructType(
    [f if f.name != "total_count" else T.StructField("total_passenger", T.LongType())
     for f in TRIPS.fields])
