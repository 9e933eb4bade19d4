"""Streaming: incremental re-use of the batch enrichment (the reference has
no streaming operators, so nothing stateful is added)."""

from .ingest import start_ticket_ingest, ticket_stream

__all__ = ["start_ticket_ingest", "ticket_stream"]
