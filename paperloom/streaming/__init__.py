"""Documents that arrive over time."""

from .ingest import document_stream, ingest, latest

__all__ = ["document_stream", "ingest", "latest"]
