"""Structured Streaming: incremental bundle ingestion (``ingest``)."""
