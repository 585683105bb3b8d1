"""Structured Streaming ingest into the seen table."""
