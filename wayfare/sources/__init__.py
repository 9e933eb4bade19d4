"""Sources and sinks."""

from .quality import observe_coerced
from .readers import (EmptyResult, RowGuard, SourceNotFound, read_dimension, read_tickets, read_trips,
                      require_rows, union_batches)
from .sinks import export_csv, export_csv_with_count, export_manifest

__all__ = ["EmptyResult", "RowGuard", "SourceNotFound", "read_dimension", "read_tickets", "read_trips",
           "require_rows", "union_batches", "observe_coerced", "export_csv", "export_csv_with_count",
           "export_manifest"]
