"""Sales questions over the curated lines: bounds, KPIs, trends, top lists.

Every function takes the curated lines (or an already filtered slice) and
returns a lazy DataFrame; nothing is collected.  Aggregates that count
distinct invoices start from ``invoice_rollup`` — one row per
(invoice, customer) pair after map-side partial aggregation — so the single
shuffle of line-sized data carries pre-aggregated rows and hot invoices or
customers collapse before they are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import DateLike, known_customer, non_blank, sales_filter
from ..functions.numeric import cents, percentage, round_half_away

MONTH = "month"


def date_bounds(lines: DataFrame) -> DataFrame:
    """``min_date, max_date`` of ``invoice_timestamp`` (one row)."""
    return lines.agg(
        F.to_date(F.min("invoice_timestamp")).alias("min_date"),
        F.to_date(F.max("invoice_timestamp")).alias("max_date"),
    )


def country_options(lines: DataFrame) -> DataFrame:
    """Sorted distinct non-blank countries."""
    return lines.where(non_blank("country")).select("country").distinct().orderBy("country")


def filtered_sales(
    lines: DataFrame,
    start: DateLike,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
    valid_sales_only: bool = True,
) -> DataFrame:
    """The lines passing ``sales_filter`` (date range, valid sales, countries)."""
    return lines.where(sales_filter(start, end, countries, valid_sales_only))


def invoice_rollup(sales: DataFrame) -> DataFrame:
    """One row per (invoice, customer): revenue in cents and last timestamp."""
    return sales.groupBy("invoice_no", "customer_id").agg(
        F.sum(cents("line_revenue")).alias("revenue_cents"),
        F.max("invoice_timestamp").alias("last_timestamp"),
    )


def customer_orders(sales: DataFrame) -> DataFrame:
    """Distinct invoices per known customer: ``customer_id, order_count``."""
    rollup = invoice_rollup(sales).where(known_customer())
    return rollup.groupBy("customer_id").agg(F.count("invoice_no").alias("order_count"))


def kpi_summary(sales: DataFrame) -> DataFrame:
    """Headline numbers of a filtered slice (one row).

    ``revenue, orders, customers, average_order_value, repeat_customer_pct``.
    An empty slice gives NULL revenue and AOV, zero counts and 0 % repeat.

    Plan: the (invoice, customer) rollup is aggregated once more with
    ``GROUPING SETS ((invoice_no), (customer_id))`` — one Expand over the
    small rollup and one exchange — and a final one-row aggregate folds the
    invoice rows (revenue, orders) and customer rows (customers, repeaters).
    No cross join and no second pass over the lines.
    """
    return rollup_kpis(invoice_rollup(sales))


def rollup_kpis(rollup: DataFrame) -> DataFrame:
    """``kpi_summary`` from the invoice rollup of the slice."""
    sets = rollup.groupingSets(
        [["invoice_no"], ["customer_id"]], "invoice_no", "customer_id"
    ).agg(
        F.sum("revenue_cents").alias("revenue_cents"),
        F.count("invoice_no").alias("order_count"),
        F.grouping_id().alias("gid"),
    )
    invoice_row = F.col("gid") == F.lit(1)  # customer_id rolled up
    customer_row = (F.col("gid") == F.lit(2)) & F.col("customer_id").isNotNull()
    totals = sets.agg(
        (F.sum(F.when(invoice_row, F.col("revenue_cents"))).cast("double") / F.lit(100.0)).alias(
            "revenue"
        ),
        F.count_if(invoice_row & F.col("invoice_no").isNotNull()).alias("orders"),
        F.count_if(customer_row).alias("customers"),
        F.count_if(customer_row & (F.col("order_count") > 1)).alias("repeaters"),
    )
    return totals.select(
        "revenue",
        "orders",
        "customers",
        round_half_away(F.try_divide(F.col("revenue"), F.col("orders").cast("double")), 2).alias(
            "average_order_value"
        ),
        F.coalesce(
            percentage(F.col("repeaters"), F.col("customers"), 2), F.lit(0.0)
        ).alias("repeat_customer_pct"),
    )


def monthly_trend(sales: DataFrame) -> DataFrame:
    """``month, revenue, orders`` per calendar month, ascending."""
    return (
        sales.groupBy(F.trunc("invoice_timestamp", "month").alias(MONTH))
        .agg(
            (F.sum(cents("line_revenue")).cast("double") / F.lit(100.0)).alias("revenue"),
            F.countDistinct("invoice_no").alias("orders"),
        )
        .orderBy(MONTH)
    )


def top_markets(sales: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` countries with the highest revenue (ties by country name)."""
    return (
        sales.groupBy("country")
        .agg(
            (F.sum(cents("line_revenue")).cast("double") / F.lit(100.0)).alias("revenue"),
            F.countDistinct("invoice_no").alias("orders"),
        )
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("country").asc_nulls_last())
        .limit(k)
    )


def top_products(sales: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` stock codes with the highest revenue among described lines.

    ``stock_code, description (lexicographic max), units_sold, orders, revenue``.
    """
    return (
        sales.where(non_blank("description"))
        .groupBy("stock_code")
        .agg(
            F.max("description").alias("description"),
            F.sum("quantity").cast("bigint").alias("units_sold"),
            F.countDistinct("invoice_no").alias("orders"),
            (F.sum(cents("line_revenue")).cast("double") / F.lit(100.0)).alias("revenue"),
        )
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("stock_code").asc_nulls_last())
        .limit(k)
    )


def top_products_chart(sales: DataFrame, k: int = 20, shown: int = 15) -> DataFrame:
    """The first ``shown`` of the top ``k`` products, re-sorted ascending."""
    top = top_products(sales, k).limit(min(k, shown))
    return top.orderBy(F.col("revenue").asc_nulls_last(), F.col("stock_code").desc_nulls_last())
