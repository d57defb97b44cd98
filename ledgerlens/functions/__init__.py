"""Column-expression building blocks (no Python UDFs)."""
