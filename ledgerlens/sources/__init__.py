"""Readers: landing files, Parquet tables, fixture views over driver tables."""
