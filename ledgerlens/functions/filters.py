"""Composable sales filters (date range, valid sales, countries).

The filter is a single boolean Column so callers can combine it freely and
Catalyst can push every conjunct into the Parquet scan: the date test is
written on the timestamp itself (half-open range) so it reaches the reader
as ``invoice_timestamp >= start AND invoice_timestamp < end + 1 day``, the
country list as an ``In`` filter.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = dt.date | dt.datetime | str


def as_date(value: DateLike) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.fromisoformat(str(value).strip()).date()


def date_range(start: DateLike, end: DateLike | None = None) -> tuple[dt.date, dt.date]:
    """A complete range, or a single day when ``end`` is missing."""
    first = as_date(start)
    last = as_date(end) if end is not None else first
    return first, last


def in_date_range(ts: Column | str, start: DateLike, end: DateLike | None = None) -> Column:
    """``CAST(ts AS DATE) BETWEEN start AND end`` as a pushable timestamp range."""
    first, last = date_range(start, end)
    column = F.col(ts) if isinstance(ts, str) else ts
    lower = dt.datetime.combine(first, dt.time.min)
    upper = dt.datetime.combine(last + dt.timedelta(days=1), dt.time.min)
    # text literals: the cast to TIMESTAMP_NTZ involves no time zone
    return (column >= F.lit(lower.isoformat(sep=" ")).cast("timestamp_ntz")) & (
        column < F.lit(upper.isoformat(sep=" ")).cast("timestamp_ntz")
    )


def sales_filter(
    start: DateLike,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
    valid_sales_only: bool = True,
) -> Column:
    """Date range, optionally valid sales only, optionally a country list.

    An empty or missing country list means every country.
    """
    condition = in_date_range("invoice_timestamp", start, end)
    if valid_sales_only:
        # NULL (blank invoice) is not true, exactly like SQL WHERE; the bare
        # column reaches the Parquet reader as IsNotNull + EqualTo(true).
        condition = condition & F.col("is_valid_sale")
    chosen = [c for c in (countries or [])]
    if chosen:
        condition = condition & F.col("country").isin(chosen)
    return condition


def known_customer() -> Column:
    return F.col("customer_id").isNotNull()


def non_blank(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != F.lit(""))
