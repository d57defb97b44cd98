"""Recency–frequency–monetary metrics, tie-aware scores and segments.

``customer_metrics`` aggregates the filtered sales per known customer;
``rfm_scores`` adds the 1..5 scores (recency inverted: recent = 5) with the
distributed exact percent-rank of ``ranking``; ``rfm_segments`` labels
customers by the ordered rules below.  ``m_score`` is computed but, as in
the reference, not used for the segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import DateLike, as_date, known_customer
from ..functions.numeric import cents
from ..session import materialize
from .ranking import quantile_scores, window_quantile_scores
from .sales import invoice_rollup

METRIC_COLUMNS = ["recency_days", "frequency", "monetary"]
SCORE_COLUMNS = ["r_score", "f_score", "m_score"]
SCORE_INVERTED = [True, False, False]

# Fixed segment rules, first match wins.
SEGMENT_CHAMPIONS = "Champions"
SEGMENT_LOYAL = "Loyal"
SEGMENT_POTENTIAL = "Potential loyalists"
SEGMENT_NEW = "New customers"
SEGMENT_AT_RISK = "At risk"
SEGMENT_HIBERNATING = "Hibernating"
SEGMENT_NEEDS_ATTENTION = "Needs attention"


def customer_metrics(sales: DataFrame, as_of: DateLike) -> DataFrame:
    """``customer_id, recency_days, frequency, monetary`` of known customers.

    Recency is measured in days from the last purchase date to ``as_of``
    (the filter's end date); frequency counts distinct invoices; monetary is
    the exact two-decimal revenue.
    """
    return rollup_metrics(invoice_rollup(sales.where(known_customer())), as_of)


def rollup_metrics(rollup: DataFrame, as_of: DateLike) -> DataFrame:
    """``customer_metrics`` from the invoice rollup of the sales."""
    return rollup.where(known_customer()).groupBy("customer_id").agg(
        F.datediff(F.lit(as_date(as_of)), F.to_date(F.max("last_timestamp")))
        .cast("bigint")
        .alias("recency_days"),
        F.count("invoice_no").alias("frequency"),
        (F.sum("revenue_cents").cast("double") / F.lit(100.0)).alias("monetary"),
    )


def rfm_scores(
    metrics: DataFrame, method: str = "distributed", materialize_input: bool = True
) -> DataFrame:
    """Append ``r_score, f_score, m_score`` (int, 1..5, ties share a score).

    ``method="distributed"`` (default) never routes the customers through a
    single task; ``"window"`` uses the built-in global ``percent_rank`` and is
    kept as a small-input oracle.  The metrics are materialised once in the
    shared checkpoint folder because the distributed method reads them in
    small jobs before the final plan; they run when this function is called.
    """
    if method == "window":
        return window_quantile_scores(metrics, METRIC_COLUMNS, SCORE_COLUMNS, SCORE_INVERTED)
    if not materialize_input:
        return quantile_scores(metrics, METRIC_COLUMNS, SCORE_COLUMNS, SCORE_INVERTED)
    source = materialize(metrics, "customer-metrics")
    return quantile_scores(source, METRIC_COLUMNS, SCORE_COLUMNS, SCORE_INVERTED)


# the same rules as SQL text over r_score and f_score
SEGMENT_SQL = f"""CASE
    WHEN r_score >= 4 AND f_score >= 4 THEN '{SEGMENT_CHAMPIONS}'
    WHEN f_score >= 4 THEN '{SEGMENT_LOYAL}'
    WHEN r_score >= 4 AND f_score BETWEEN 2 AND 3 THEN '{SEGMENT_POTENTIAL}'
    WHEN r_score = 5 AND f_score = 1 THEN '{SEGMENT_NEW}'
    WHEN r_score <= 2 AND f_score >= 3 THEN '{SEGMENT_AT_RISK}'
    WHEN r_score <= 2 THEN '{SEGMENT_HIBERNATING}'
    ELSE '{SEGMENT_NEEDS_ATTENTION}' END"""


def segment_of(r: Column, f: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4), F.lit(SEGMENT_CHAMPIONS))
        .when(f >= 4, F.lit(SEGMENT_LOYAL))
        .when((r >= 4) & f.between(2, 3), F.lit(SEGMENT_POTENTIAL))
        .when((r == 5) & (f == 1), F.lit(SEGMENT_NEW))
        .when((r <= 2) & (f >= 3), F.lit(SEGMENT_AT_RISK))
        .when(r <= 2, F.lit(SEGMENT_HIBERNATING))
        .otherwise(F.lit(SEGMENT_NEEDS_ATTENTION))
    )


def rfm_segments(scored: DataFrame) -> DataFrame:
    """Append ``segment`` from ``r_score`` and ``f_score``."""
    return scored.withColumn("segment", segment_of(F.col("r_score"), F.col("f_score")))


def customer_segments(
    sales: DataFrame, as_of: DateLike, method: str = "distributed"
) -> DataFrame:
    """Metrics → scores → segment for the filtered sales (the RFM table)."""
    return rfm_segments(rfm_scores(customer_metrics(sales, as_of), method=method))


def segment_summary(segments: DataFrame) -> DataFrame:
    """``segment, customers, revenue`` — largest segment first."""
    return (
        segments.groupBy("segment")
        .agg(
            F.count("customer_id").alias("customers"),
            (F.sum(cents("monetary")).cast("double") / F.lit(100.0)).alias("revenue"),
        )
        .orderBy(F.col("customers").desc(), F.col("segment").asc())
    )


def value_distribution(segments: DataFrame) -> DataFrame:
    """Per-customer feed of the value chart."""
    return segments.select("frequency", "monetary", "segment", "customer_id", "recency_days")
