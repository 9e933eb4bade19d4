"""Prepared inputs of the registered queries.

``Inputs`` builds, once per session and data folder, the cleaned tables the
dashboards share: enriched tickets (with the default global filter) and the
three trip cleanings.  With ``persist=True`` the cleaned tables are kept in
executor memory / disk (recomputed from lineage if an executor is lost),
which is how an interactive dashboard reuses its loaded table.  With
``materialize="table"`` they are instead written as parquet partitioned by
month below the shared checkpoint folder and read back: lineage is cut, a
lost executor costs nothing, and ticket date-range filters prune months.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, enrich, filters
from ..session import scratch_path
from ..sources import fixtures
from ..sources.footers import footer_bounds

# partition column of each materialised table and the timestamp it is cut from
PARTITIONS = {"enriched": ("ticket_month", "ticket_datetime"),
              "trips_basic": ("run_month", "running_date"),
              "trips_extended": ("run_month", "running_date"),
              "trips_monthly": ("run_month", "running_date")}


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str, persist: bool = False,
                 materialize: str | None = None):
        if materialize not in (None, "table"):
            raise ValueError("materialize must be None or 'table'")
        self.spark = spark
        self.sf_dir = sf_dir
        self.persist = persist
        self.materialize = materialize
        self.paths: dict[str, str] = {}        # of the materialised tables

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.materialize == "table":
            part, ts = PARTITIONS[name]
            path = self.paths[name] = scratch_path(self.spark, "tables", uuid.uuid4().hex, name)
            (df.withColumn(part, F.date_format(ts, "yyyy-MM"))
               .write.partitionBy(part).parquet(path))
            return self.spark.read.parquet(path)
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else df

    # ---------------------------------------------------------------- tickets
    def _keep_raw(self, df: DataFrame) -> DataFrame:
        """Raw fact rows as loaded, kept only in persist mode."""
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else df

    @cached_property
    def tickets(self) -> DataFrame:
        return self._keep_raw(fixtures.tickets(self.spark, self.sf_dir))

    @cached_property
    def ticket_types(self) -> DataFrame:
        return fixtures.ticket_types(self.spark, self.sf_dir)

    @cached_property
    def service_types(self) -> DataFrame:
        return fixtures.service_types(self.spark, self.sf_dir)

    @cached_property
    def form_four(self) -> DataFrame:
        return fixtures.form_four(self.spark, self.sf_dir)

    @cached_property
    def enriched(self) -> DataFrame:
        """All tickets after lookups, timestamps, ratios and km override."""
        return self._keep(enrich.enrich_tickets(self.tickets, self.ticket_types,
                                                self.service_types, self.form_four), "enriched")

    @cached_property
    def default_range(self):
        """Default global date range (first date, last date).

        For a reused (persisted / materialised) table it is computed once, as
        the dashboard does for its date widget, and becomes two literal
        dates (of a materialised table from its Parquet footers, without a row);
        otherwise it stays a lazy scalar subquery of each plan, over
        the raw tickets' date and time columns.
        """
        if self.materialize:
            self.enriched  # noqa: B018 - written on first use
            b = footer_bounds(self.spark, self.paths["enriched"], ["ticket_date"])
            return (b.min_ticket_date, b.max_ticket_date)
        if self.persist:
            b = self.enriched.agg(F.to_date(F.min("ticket_datetime")).alias("d0"),
                                  F.to_date(F.max("ticket_datetime")).alias("d1")).first()
            return (b.d0, b.d1)
        # the lookups keep every ticket, so the bounds need the raw rows only
        return filters.default_date_range(enrich.parse_ticket_datetime(self.tickets))

    @cached_property
    def filtered(self) -> DataFrame:
        """Enriched tickets under the default global filter (first date ..
        last date at midnight, all services)."""
        return filters.filter_global(self.enriched, self.default_range)

    # ---------------------------------------------------------------- trips
    @cached_property
    def trips(self) -> DataFrame:
        return self._keep_raw(fixtures.trips(self.spark, self.sf_dir))

    @cached_property
    def trips_basic(self) -> DataFrame:
        return self._keep(clean.clean_trips_basic(self.trips), "trips_basic")

    @cached_property
    def trips_extended(self) -> DataFrame:
        return self._keep(clean.clean_trips_extended(self.trips), "trips_extended")

    @cached_property
    def trips_monthly_raw(self) -> DataFrame:
        return self._keep_raw(fixtures.trips_monthly(self.spark, self.sf_dir))

    @cached_property
    def trips_monthly(self) -> DataFrame:
        return self._keep(clean.clean_trips_monthly(self.trips_monthly_raw), "trips_monthly")

    def release(self) -> None:
        for name in ("tickets", "trips", "trips_monthly_raw", "enriched", "trips_basic",
                     "trips_extended", "trips_monthly"):
            if name in self.__dict__ and self.persist:
                self.__dict__[name].unpersist()
