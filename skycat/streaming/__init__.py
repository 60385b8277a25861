"""Structured Streaming entry points (incremental catalogue ingest)."""
