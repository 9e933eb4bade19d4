"""File sources (S1-S7): declared-schema scans and their error contract."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .quality import observe_coerced


class SourceNotFound(FileNotFoundError):
    """A required input path does not exist."""


class EmptyResult(ValueError):
    """No rows are left after cleaning or filtering."""


CORRUPT = "_torn_line"


def _load(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None, **options) -> DataFrame:
    try:
        reader = spark.read
        if fmt == "csv":
            reader = reader.options(**{"header": True, "mode": "PERMISSIVE"} | options)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.format(fmt).load(path)
        # Resolve the file listing eagerly so a missing path fails here.
        df.schema  # noqa: B018
        return df
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise SourceNotFound(f"data file not found: {path}") from exc
        raise


def _typed(spark: SparkSession, path: str, fmt: str, schema: T.StructType, header: bool,
           counts: Observation | None, rescued: str | None) -> DataFrame:
    """Scan with the declared types, and what a lenient CSV read loses: counters
    of malformed values and of lines with too few or too many fields, and the
    column ``rescued``, a map from column to the text that was no value of its
    type (the whole line under ``_torn_line``), NULL for a sound row."""
    if fmt != "csv" or (counts is None and rescued is None):
        return _load(spark, path, fmt, schema if fmt == "csv" else None, header=header)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    # pruned columns would hide torn lines
    raw = _load(spark, path, fmt, text, header=header, columnNameOfCorruptRecord=CORRUPT, columnPruning=False)
    typed = {f.name: F.col(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType)
             for f in schema.fields}
    pairs = {n: (F.col(n), c) for n, c in typed.items() if not isinstance(schema[n].dataType, T.StringType)}
    torn = F.col(CORRUPT).isNotNull()
    bad = reduce(lambda a, b: a | b, [x.isNotNull() & y.isNull() for x, y in pairs.values()], torn)
    raw = observe_coerced(raw, counts, pairs, torn_lines=torn, malformed_rows=bad)
    if rescued is None:
        return raw.select([c.alias(n) for n, c in typed.items()])
    lost = [F.struct(F.lit(n).alias("k"), F.when(y.isNull(), x).alias("v")) for n, (x, y) in pairs.items()]
    lost = F.filter(F.array(*lost, F.struct(F.lit(CORRUPT).alias("k"), F.col(CORRUPT).alias("v"))), lambda e: e["v"].isNotNull())
    return raw.select(*[c.alias(n) for n, c in typed.items()], F.when(bad, F.map_from_entries(lost)).alias(rescued))


def read_tickets(spark: SparkSession, path: str, fmt: str = "csv", header: bool = True,
                 counts: Observation | None = None, rescued: str | None = None) -> DataFrame:
    """Ticket fact scan with the declared schema.

    Replaces the chunked reader: Spark splits the files into tasks, so no
    chunking, per-chunk transform or concatenation is needed.  ``counts`` and
    ``rescued``: see ``_typed``; without them a malformed CSV value is NULL.
    """
    df = _typed(spark, path, fmt, S.TICKETS, header, counts, rescued)
    kept = [F.col(f.name).cast(f.dataType) for f in S.TICKETS.fields]
    return df.select(*kept, *([rescued] if rescued in df.columns else []))


def read_dimension(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "csv", counts: Observation | None = None) -> DataFrame:
    """Small lookup table plus an ``ord`` column that follows file order.

    ``ord`` is (file, block, row position): files by path, the blocks of a file
    by offset, then the position in which a task reads the block, so "last row
    wins" holds over several files however they are packed into tasks.
    ``counts`` observes the malformed values.
    """
    df = _typed(spark, path, fmt, schema, True, None, None)
    if fmt == "csv" and counts is not None:
        text = _load(spark, path, fmt, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
        pairs = {f.name: (F.col(f.name), F.col(f.name).try_cast(f.dataType)) for f in schema.fields}
        df = observe_coerced(text, counts, pairs)
        df = df.withColumns({n: c for n, (_, c) in pairs.items()})
    ordinal = F.struct(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], ordinal.alias("ord"))


def read_trips(spark: SparkSession, root: str, sheet: str | None = None,
               fmt: str = "parquet", monthly: bool = False) -> DataFrame:
    """Trip sheet scan.  A workbook sheet is stored as ``{root}/{sheet}``.

    Columns keep the sheet's own text or numbers (CSV: text) and an absent one
    stays absent: coercion and defaults are the cleaning's part.  The monthly
    sheet is typed strictly, as its dashboard does."""
    path = f"{root}/{sheet}" if sheet else root
    schema = S.TRIPS_MONTHLY if monthly else S.TRIPS
    raw = _load(spark, path, fmt, None)
    df = raw.select([F.col(f.name) for f in schema.fields if f.name in raw.columns])
    if not monthly:
        return df
    return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in df.columns])


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Bag union of batches with the same columns (by name)."""
    return reduce(lambda a, b: a.unionByName(b), batches)


def require_rows(df: DataFrame, what: str = "data") -> DataFrame:
    """Raise ``EmptyResult`` when ``df`` has no rows (one-row probe)."""
    if df.isEmpty():
        raise EmptyResult(f"no valid {what} remaining")
    return df


class RowGuard:
    """The same guard without a probe: rows are counted by the action that uses
    them (S7)::

        guard = RowGuard("trips")
        guard.watch(trips).write.parquet(target)
        guard.check()
    """

    def __init__(self, what: str = "data"):
        self.what = what
        self._seen = Observation(f"rows of {what}")

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, F.count(F.lit(1)).alias("rows"))

    def check(self) -> int:
        """The rows that the first action on the watched frame has read;
        ``EmptyResult`` if there were none."""
        rows = self._seen.get["rows"]
        if not rows:
            raise EmptyResult(f"no valid {self.what} remaining")
        return rows
