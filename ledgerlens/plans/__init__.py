"""End-to-end jobs and plan inspection helpers."""
