"""Bucketed tables: facts and lookup tables prepared once for repeated joins.

Tables bucketed alike on their join keys meet without an exchange, however many
batches are enriched later.  They are catalog tables whose files lie below the
shared folder; ``drop_bucketed`` removes both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..scratch import drop_path, new_path


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` written bucketed and sorted by ``keys`` (default: as many buckets as
    shuffle partitions) and read back.  Rows are dealt by the keys first, so each
    bucket is one file."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
     .option("path", new_path(spark, table)).saveAsTable(table))
    out = spark.table(table)
    out._bucketed_table = table
    return out


def drop_bucketed(df: DataFrame) -> None:
    """Remove a table of ``save_bucketed`` from the catalog and its files."""
    spark = df.sparkSession
    location = spark.sql(f"DESCRIBE FORMATTED {df._bucketed_table}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {df._bucketed_table}")
    drop_path(spark, location)
