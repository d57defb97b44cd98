"""Structured Streaming entry points for the ingest path."""
