"""Incremental ticket ingestion with Structured Streaming.

New ticket CSV files dropped into a landing folder are enriched with the
same operators as the batch path (ticket/service lookups, timestamp,
ratios, route-distance override) and appended to a parquet table
partitioned by month.  The dimensions are static DataFrames, so every join
is a stream-static left join; nothing is stateful.  ``availableNow``
processes what has landed and stops, which is how a scheduled refresh runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators.enrich import enrich_tickets
from ..session import scratch_path


def ticket_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of header CSV ticket files with the declared schema."""
    reader = spark.readStream.schema(S.TICKETS).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(landing_dir)


def start_ticket_ingest(spark: SparkSession, landing_dir: str, ticket_types: DataFrame,
                        service_types: DataFrame, form_four: DataFrame, out_dir: str,
                        checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the ingest; returns the running ``StreamingQuery``."""
    enriched = enrich_tickets(ticket_stream(spark, landing_dir), ticket_types, service_types, form_four)
    enriched = enriched.withColumn("ticket_month", F.date_format("ticket_datetime", "yyyy-MM"))
    writer = (enriched.writeStream.format("parquet").outputMode("append")
              .partitionBy("ticket_month")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "ingest", uuid.uuid5(uuid.NAMESPACE_URL, out_dir).hex)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out_dir)
