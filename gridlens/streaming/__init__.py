"""Structured Streaming versions of ingest, hourly means and the audit."""
