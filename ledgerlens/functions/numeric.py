"""Rounding, money sums and safe ratios as Column expressions.

Decisions taken once for the whole library:

* ``round_half_away(x, n)`` rounds the binary double ``x * 10^n`` half away
  from zero and divides back.  This is what the reference's SQL engine does
  for ``ROUND(double, n)``; Spark's ``round(x, n)`` instead rounds the
  decimal text of ``x`` (1.005 → 1.01 versus 1.0).
* Money is summed as whole cents in a ``bigint`` and divided by 100 at the
  end.  Integer sums are exact and associative, so a total never depends on
  partitioning, task order or partial-aggregation shape — a double sum over
  10^12 rows does.
* Ratios never raise under ANSI mode: ``try_divide`` yields NULL on a zero
  denominator, which is the reference's ``NULLIF(x, 0)`` guard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c: Column | str, digits: int = 2) -> Column:
    """``ROUND(x, digits)`` with half-away-from-zero on the binary value."""
    scale = float(10**digits)
    x = _col(c)
    rounded = F.round(x * F.lit(scale), 0) / F.lit(scale)
    # a zero result keeps the sign of the input (-0.004 → -0.0), as in C
    return F.when(rounded == F.lit(0.0), x * F.lit(0.0)).otherwise(rounded)


def cents(c: Column | str) -> Column:
    """A two-decimal money amount as exact whole cents (bigint)."""
    return F.round(_col(c) * F.lit(100.0), 0).cast("bigint")


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """``ROUND(100.0 * part / whole, digits)``, NULL when ``whole`` is 0."""
    return round_half_away(
        F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), digits
    )


def format_integer(c: Column | str) -> Column:
    """Thousands-separated whole number of the truncated value ("1,234")."""
    return F.format_number(_col(c).cast("bigint"), 0)


def format_currency(c: Column | str, currency: str = "GBP") -> Column:
    """``"GBP 1,235"``: rounded half to even, thousands separated."""
    return F.concat(F.lit(f"{currency} "), F.format_number(_col(c), 0))
