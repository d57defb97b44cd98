"""ledgerlens — Spark-native retail transaction analytics.

Build the curated dataset with ``build_dataset`` and query it with the
DataFrame-in, DataFrame-out operators below (all lazy; nothing is
collected unless the caller asks).
"""

from .functions.filters import sales_filter
from .operators.cohort import cohort_matrix, cohort_retention, customer_cohorts
from .operators.quality import quality_filtered, quality_signals, quality_summary
from .operators.rfm import (
    customer_metrics,
    customer_segments,
    rfm_scores,
    rfm_segments,
    segment_summary,
    value_distribution,
)
from .operators.sales import (
    country_options,
    customer_orders,
    date_bounds,
    filtered_sales,
    kpi_summary,
    monthly_trend,
    top_markets,
    top_products,
    top_products_chart,
)
from .plans.datasets import ensure_dataset
from .plans.job import build_dataset
from .plans.report import refresh_page
from .session import get_session

__all__ = [
    "build_dataset",
    "cohort_matrix",
    "cohort_retention",
    "country_options",
    "customer_cohorts",
    "customer_metrics",
    "customer_orders",
    "customer_segments",
    "date_bounds",
    "ensure_dataset",
    "filtered_sales",
    "get_session",
    "kpi_summary",
    "monthly_trend",
    "quality_filtered",
    "quality_signals",
    "quality_summary",
    "refresh_page",
    "rfm_scores",
    "rfm_segments",
    "sales_filter",
    "segment_summary",
    "top_markets",
    "top_products",
    "top_products_chart",
    "value_distribution",
]
