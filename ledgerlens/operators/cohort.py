"""Monthly cohort retention: long table and matrix.

The cohort of a customer is the first month with a purchase *inside the
filtered slice*.  Plan: the set of months of each customer (one exchange,
partially aggregated map-side; a set holds at most one entry per calendar
month, so it does not grow with the data) → its least month and its entries
as rows → plain count per (cohort, index) → MAX window per cohort over a
table of at most months² rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import known_customer
from ..functions.numeric import round_half_away

DEFAULT_MAX_INDEX = 12


def customer_months(sales: DataFrame) -> DataFrame:
    """``customer_id, months``: the distinct months of each known customer."""
    month = F.trunc("invoice_timestamp", "month")
    return sales.where(known_customer()).groupBy("customer_id").agg(F.collect_set(month).alias("months"))


def customer_cohorts(sales: DataFrame) -> DataFrame:
    """``customer_id, cohort_month, order_month``."""
    return customer_months(sales).select(
        "customer_id",
        F.array_min("months").alias("cohort_month"),
        F.explode("months").alias("order_month"),
    )


def cohort_retention(sales: DataFrame, max_index: int = DEFAULT_MAX_INDEX) -> DataFrame:
    """``cohort_month, cohort_index, retention_pct`` for indexes ≤ ``max_index``.

    ``retention_pct`` is customers active in the month over the largest
    month of the cohort, in percent with one decimal.  The index filter is
    applied before the MAX window, as in the reference.
    """
    cohorts = customer_cohorts(sales)
    counts = cohorts.groupBy(
        "cohort_month",
        F.months_between("order_month", "cohort_month").cast("bigint").alias("cohort_index"),
    ).agg(F.count(F.lit(1)).alias("customers"))
    kept = counts.where(F.col("cohort_index") <= max_index)
    largest = F.max("customers").over(Window.partitionBy("cohort_month"))
    return kept.select(
        "cohort_month",
        "cohort_index",
        round_half_away(
            F.lit(100.0) * F.col("customers").cast("double") / largest.cast("double"), 1
        ).alias("retention_pct"),
    ).orderBy("cohort_month", "cohort_index")


def cohort_matrix(retention: DataFrame, max_index: int = DEFAULT_MAX_INDEX) -> DataFrame:
    """One row per cohort (``cohort_month`` as text) and columns ``m0..m{max}``.

    The pivot values are listed explicitly, so no extra job collects them;
    a missing cell is NULL.
    """
    indexes = list(range(max_index + 1))
    wide = (
        retention.groupBy(F.col("cohort_month").cast("string").alias("cohort_month"))
        .pivot("cohort_index", indexes)
        .agg(F.first("retention_pct"))
    )
    return wide.select(
        "cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in indexes]
    ).orderBy("cohort_month")
