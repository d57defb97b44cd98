"""Data-quality measures of the curated lines (one pass each)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import DateLike, sales_filter
from ..functions.numeric import cents

# Fixed labels of the quality-signal chart feed, in this order.
ISSUE_LABELS = [
    ("Cancelled invoice", "cancelled_rows"),
    ("Missing customer ID", "missing_customer_rows"),
    ("Non-positive quantity", "non_positive_quantity_rows"),
    ("Non-positive price", "non_positive_price_rows"),
]


def _signal_counts() -> list:
    return [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("is_valid_sale")).alias("valid_sale_rows"),
        F.count_if(F.col("is_cancelled")).alias("cancelled_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer_rows"),
        F.count_if(F.col("quantity") <= 0).alias("non_positive_quantity_rows"),
        F.count_if(F.col("unit_price") <= 0).alias("non_positive_price_rows"),
    ]


def quality_summary(lines: DataFrame) -> DataFrame:
    """Nine measures of the whole table (one row)."""
    return lines.agg(
        *_signal_counts(),
        F.min("invoice_timestamp").alias("first_transaction"),
        F.max("invoice_timestamp").alias("last_transaction"),
        (
            F.sum(F.when(F.col("is_valid_sale"), cents("line_revenue"))).cast("double")
            / F.lit(100.0)
        ).alias("valid_revenue"),
    )


def quality_filtered(
    lines: DataFrame,
    start: DateLike,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """The six row counts over the date/country slice, invalid rows included."""
    return lines.where(sales_filter(start, end, countries, valid_sales_only=False)).agg(
        *_signal_counts()
    )


def quality_signals(quality: DataFrame) -> DataFrame:
    """Four quality counts as ``(issue, rows)``, fewest first.

    Ties keep the listed order of the issues (a stable sort).
    """
    triples = ", ".join(
        f"'{label}', {column}, {position}"
        for position, (label, column) in enumerate(ISSUE_LABELS)
    )
    stacked = quality.selectExpr(
        f"stack({len(ISSUE_LABELS)}, {triples}) AS (issue, rows, position)"
    )
    return stacked.orderBy(F.col("rows").asc_nulls_last(), "position").drop("position")
