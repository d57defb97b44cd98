"""A key for whole rows, and names that no column has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(id_col: str, text_col: str) -> Column:
    """A key that tells rows with different ids or texts apart, nulls included."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
