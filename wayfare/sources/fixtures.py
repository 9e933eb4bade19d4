"""Bindings of the driver's TPC-H-like tables to the transit schemas.

The reference ships no data, so the logical tables are bound to columns of
``lineitem`` / ``orders`` / ``customer`` / ``supplier`` / ``nation`` /
``region`` as specified in FIXTURES.md.  These functions only *shape* rows
into the expected schemas (including the injected NULLs and malformed text
that exercise the cleaning rules); every analytic step happens later in the
library operators, which do not rely on how the rows were made.

Scale notes: ``tickets`` needs lineitem joined to orders (a fact-to-fact
equi-join on the order key, shuffled on both sides unless the tables are
bucketed on it); customer is joined to orders first, so that lineitem is never
shuffled on the customer; supplier / nation / region are joined one by one as
dimensions that Catalyst broadcasts by their size.  ``trips`` only touches
dimensions, so it is a map-only plan over lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Schemas of the bound tables: declared, so that building a plan reads no footer.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _two(c) -> F.Column:
    return F.lpad(c.cast("string"), 2, "0")


def _with_nation(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with their supplier's nation, one dimension at a time: each has a
    known size, while the estimate of dimensions joined to each other first is their
    product, and the facts would be shuffled on the supplier."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket-level fact rows (schema ``wayfare.schema.TICKETS``)."""
    minute = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1440
    # shaped before the shuffle, so that it moves short values
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", minute.alias("minute"),
        (F.col("l_partkey") % 40).alias("schedule"), F.round(F.col("l_discount") * 1000).alias("km"),
        F.to_date("l_shipdate").alias("day"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ordered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    j = _with_nation(li.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")), spark, sf_dir)
    minute = F.col("minute")
    return j.select(
        F.col("c_nationkey").cast("int").alias("ticket_type_short_code"),
        F.col("n_regionkey").cast("int").alias("bus_service_id"),
        F.date_format("day", "yyyy-MM-dd").alias("ticket_date"),
        F.concat_ws(":", _two(F.floor(minute / 60)), _two(minute % 60), F.lit("00")).alias("ticket_time"),
        F.col("l_extendedprice").alias("px_total_amount"),
        F.col("l_quantity").cast("bigint").alias("px_count"),
        F.col("km").alias("travelled_KM"),
        F.col("schedule").cast("string").alias("schedule_no"),
        F.col("l_suppkey").alias("route_id"),
        F.col("l_suppkey").cast("string").alias("route_no"),
        F.col("l_orderkey").alias("trip_no"),
        F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("vehicle_no"),
    )


def ticket_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket-type dimension with an explicit row ordinal ``ord``."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("ticket_type_id"),
        F.col("n_name").alias("ticket_type_name"),
        F.col("n_nationkey").cast("long").alias("ord"))


def service_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service-type dimension: regions 0-3 plus two later, duplicate-key rows
    carrying the names the sustainability page looks for."""
    regions = table(spark, sf_dir, "region").where(F.col("r_regionkey") <= 3).select(
        F.col("r_regionkey").cast("int").alias("service_type_id"),
        F.col("r_name").alias("service_type_name"),
        F.col("r_regionkey").cast("long").alias("ord"))
    extra = spark.createDataFrame(
        [(0, "EV INTERSTATE", 10), (1, "MANUAL LOCAL INTERSTATE", 11)],
        "service_type_id int, service_type_name string, ord long")
    return regions.unionByName(extra)


def form_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route-distance table (schedule_no, route_id) -> kms, with duplicates.

    ``ord`` is the row order (order key, line number, part key) so that the
    last row per key can win; a NULL ``kms`` is a present value.
    """
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return li.select(
        (F.col("l_partkey") % 40).cast("string").alias("schedule_no"),
        F.col("l_suppkey").alias("route_id"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("kms"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
    )


def _trip_rows(spark: SparkSession, sf_dir: str, bad_dates: bool) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = _with_nation(li, spark, sf_dir).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    date_text = F.date_format("l_shipdate", "yyyy-MM-dd")
    if bad_dates:
        date_text = F.when(F.col("l_orderkey") % 97 == 0, F.lit("bad")).otherwise(date_text)
    return j.select(
        date_text.alias("running_date"),
        F.when(F.col("n_regionkey") == 4, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("color_line"),
        F.when(F.col("l_suppkey") % 50 == 13, F.lit(None).cast("string"))
         .otherwise(F.col("l_suppkey").cast("string")).alias("route_no"),
        (F.col("l_partkey") % 40).cast("string").alias("schedule_number"),
        F.when(F.col("l_orderkey") % 89 == 0, F.lit("x"))
         .otherwise(F.col("l_linenumber").cast("string")).alias("trip_number"),
        F.col("l_extendedprice").alias("total_amount"),
        F.when(F.col("l_partkey") % 83 == 0, F.lit(None).cast("double"))
         .otherwise(F.round(F.col("l_discount") * 1000)).alias("travel_distance"),
        F.when(F.col("l_partkey") % 79 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("l_quantity").cast("bigint")).alias("total_count"),
        F.concat_ws(":", _two(F.floor(F.col("l_quantity").cast("int") / 2)),
                    _two(F.col("l_orderkey") % 60), F.lit("00")).alias("running_time"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trip rows (schema ``wayfare.schema.TRIPS``) with injected defects."""
    return _trip_rows(spark, sf_dir, bad_dates=True)


def trips_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip rows of the month-comparison sheet (``total_passenger``).

    That dashboard parses dates strictly and stops on unparsable ones, so
    this binding keeps the real ship date; every other defect stays.
    """
    return (_trip_rows(spark, sf_dir, bad_dates=False)
            .withColumnRenamed("total_count", "total_passenger"))
