"""Ticket enrichment (D1-D7, J1, J2): lookups, timestamps, per-km ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe_div, zero_to_one
from ..scratch import keep_table
from .joins import dedupe_last, lookup, lookup_with_fallback


def map_ticket_type(tickets: DataFrame, ticket_types: DataFrame) -> DataFrame:
    """``ticket_type`` name from ``ticket_type_short_code``."""
    return lookup(tickets, ticket_types, "ticket_type_short_code", "ticket_type_id",
                  "ticket_type_name", "ticket_type")


def map_service_type(tickets: DataFrame, service_types: DataFrame) -> DataFrame:
    """``service_type`` name from ``bus_service_id``."""
    return lookup(tickets, service_types, "bus_service_id", "service_type_id",
                  "service_type_name", "service_type")


def parse_ticket_datetime(tickets: DataFrame) -> DataFrame:
    """``ticket_datetime`` from date + time text (NULL if either part is
    NULL; a malformed value fails the query), then ``ticket_date`` becomes its
    date part."""
    ts = F.to_timestamp_ntz(F.concat("ticket_date", F.lit(" "), "ticket_time"),
                            F.lit("yyyy-MM-dd HH:mm:ss"))
    return (tickets.withColumn("ticket_datetime", ts)
                   .withColumn("ticket_date", F.to_date("ticket_datetime")))


def add_ratios(tickets: DataFrame) -> DataFrame:
    """Revenue and passengers per km, where a 0 km divisor counts as 1."""
    km = zero_to_one(F.col("travelled_KM"))
    return (tickets.withColumn("revenue_per_km", safe_div(F.col("px_total_amount"), km))
                   .withColumn("passengers_per_km", safe_div(F.col("px_count").cast("double"), km)))


def override_distance(tickets: DataFrame, form_four: DataFrame) -> DataFrame:
    """``travelled_KM`` from the route-distance table where
    (schedule_no, route_id) is listed; otherwise the ticket's own km."""
    return lookup_with_fallback(tickets, form_four, ["schedule_no", "route_id"], "kms",
                                "travelled_KM")


def prepare_dimensions(ticket_types: DataFrame, service_types: DataFrame,
                       form_four: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three lookup tables de-duplicated once (last row wins) and written, so
    that any number of batches is enriched without reading their sources again."""
    return (keep_table(dedupe_last(ticket_types, ["ticket_type_id"], ["ticket_type_name"]), "ticket_types"),
            keep_table(dedupe_last(service_types, ["service_type_id"], ["service_type_name"]), "service_types"),
            keep_table(dedupe_last(form_four, ["schedule_no", "route_id"], ["kms"]), "form_four"))


def enrich_tickets(tickets: DataFrame, ticket_types: DataFrame, service_types: DataFrame,
                   form_four: DataFrame) -> DataFrame:
    """All ticket derivations.

    The ratios are computed *before* the distance override, so they use the
    raw km while totals use the mapped km.  The names are looked up *after* it: the
    route-distance table may be too large to broadcast, and the tickets are
    then shuffled without the names.
    """
    df = add_ratios(parse_ticket_datetime(tickets))
    df = override_distance(df, form_four)
    df = map_ticket_type(df, ticket_types)
    df = map_service_type(df, service_types)
    derived = ["ticket_type", "service_type", "ticket_datetime", "revenue_per_km", "passengers_per_km"]
    return df.select(*[c for c in tickets.columns if c not in derived], *derived)
