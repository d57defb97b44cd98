"""SQL entry points: register relations, functions, and run parameterised SQL (S11, S12).

For users who prefer SQL text over the DataFrame operators: the filter of
``functions.filters.sales_filter`` is also available as a SQL condition with
named parameter markers, and ``run_sql`` binds values through Spark's
parameterised ``spark.sql(text, args=...)`` (no string splicing of values).
The result is a lazy DataFrame planned by Catalyst like any other.

``register_functions`` makes the sales filter, the customer metrics, the scores
and the segments callable from SQL text, as temporary SQL functions.  Catalyst
puts a function's body in the caller's place, so a call with literals is pushed
to the Parquet reader like the DataFrame operator, and no Python runs:

    filtered_sales(first, last, countries)    rows of the registered lines
    customer_metrics(first, last, countries)  one row per known customer
    rfm_score(value, breaks, inverted)        1 to 5, from the least value of each score
    rfm_segment(r_score, f_score)             the segment's name
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.filters import DateLike, date_range
from ..operators.ranking import SCORE_LEVELS, score_breaks
from ..operators.rfm import METRIC_COLUMNS, SEGMENT_SQL
from ..session import materialize


def register(df: DataFrame, name: str) -> str:
    """Expose ``df`` to SQL as a temporary view named ``name``."""
    df.createOrReplaceTempView(name)
    return name


def sales_filter_sql(
    start: DateLike,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
    valid_sales_only: bool = True,
) -> tuple[str, dict[str, Any]]:
    """The sales filter as SQL text plus its named parameters.

    The date test compares the timestamp with a half-open range, so it is
    pushed to the Parquet reader like the DataFrame form.
    """
    first, last = date_range(start, end)
    args: dict[str, Any] = {
        "start_ts": dt.datetime.combine(first, dt.time.min).isoformat(sep=" "),
        "end_ts": dt.datetime.combine(last + dt.timedelta(days=1), dt.time.min).isoformat(sep=" "),
    }
    parts = [
        "invoice_timestamp >= CAST(:start_ts AS TIMESTAMP_NTZ)",
        "invoice_timestamp < CAST(:end_ts AS TIMESTAMP_NTZ)",
    ]
    if valid_sales_only:
        parts.append("is_valid_sale")
    chosen = list(countries or [])
    if chosen:
        names = [f"country_{i}" for i in range(len(chosen))]
        args.update(dict(zip(names, chosen)))
        parts.append("country IN (" + ", ".join(f":{n}" for n in names) + ")")
    return " AND ".join(parts), args


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run parameterised SQL; returns a lazy DataFrame."""
    return spark.sql(text, args=dict(args or {}))


LINES_VIEW = "sales_lines"

_FUNCTIONS = {
    "filtered_sales": """(first DATE, last DATE, countries ARRAY<STRING>)
        RETURNS TABLE ({columns})
        RETURN SELECT {names} FROM {view}
        WHERE invoice_timestamp >= CAST(first AS TIMESTAMP_NTZ)
          AND invoice_timestamp < CAST(date_add(last, 1) AS TIMESTAMP_NTZ)
          AND is_valid_sale
          AND (countries IS NULL OR size(countries) = 0 OR array_contains(countries, country))""",
    "customer_metrics": """(first DATE, last DATE, countries ARRAY<STRING>)
        RETURNS TABLE (customer_id BIGINT, recency_days BIGINT, frequency BIGINT, monetary DOUBLE)
        RETURN WITH invoices AS (
            SELECT s.customer_id, s.invoice_no, max(s.invoice_timestamp) AS last_line,
                   sum(CAST(round(s.line_revenue * 100) AS BIGINT)) AS cents
            FROM filtered_sales(customer_metrics.first, customer_metrics.last, customer_metrics.countries) s
            WHERE s.customer_id IS NOT NULL GROUP BY s.customer_id, s.invoice_no)
        SELECT customer_id, CAST(datediff(customer_metrics.last, CAST(max(last_line) AS DATE)) AS BIGINT),
               count(invoice_no), CAST(sum(cents) AS DOUBLE) / 100
        FROM invoices GROUP BY customer_id""",
    "rfm_score": """(value DOUBLE, breaks ARRAY<DOUBLE>, inverted BOOLEAN)
        RETURNS INT
        RETURN CASE WHEN value IS NULL THEN NULL WHEN inverted THEN {levels} - ({above}) ELSE 1 + ({above}) END""",
    "rfm_segment": """(r_score INT, f_score INT)
        RETURNS STRING
        RETURN {segment}""",
}


def register_functions(lines: DataFrame, view: str = LINES_VIEW) -> list[str]:
    """Register ``lines`` as ``view`` and the functions over it; the functions' names.

    They live as long as the session.  Registering again replaces them.
    """
    spark = lines.sparkSession
    register(lines, view)
    above = " + ".join(f"CASE WHEN value >= get(breaks, {i}) THEN 1 ELSE 0 END" for i in range(SCORE_LEVELS - 1))
    parts = {
        "view": view,
        "columns": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields),
        "names": ", ".join(lines.columns),
        "levels": SCORE_LEVELS,
        "above": above,
        "segment": SEGMENT_SQL,
    }
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body.format(**parts)}")
    return list(_FUNCTIONS)


def score_thresholds(metrics: DataFrame) -> dict[str, list[float | None]]:
    """For each metric the least value of the scores 2 to 5, as ``rfm_score`` takes them; None where no value has it."""
    out = {}
    for column, breaks in score_breaks(metrics, METRIC_COLUMNS).items():
        out[column] = [min((value for value, score in breaks if score >= s), default=None) for s in range(2, SCORE_LEVELS + 1)]
    return out


_SEGMENTS = """
SELECT *, rfm_segment(r_score, f_score) AS segment FROM (
    SELECT *,
           rfm_score(recency_days, CAST(:recency_days AS ARRAY<DOUBLE>), true) AS r_score,
           rfm_score(frequency, CAST(:frequency AS ARRAY<DOUBLE>), false) AS f_score,
           rfm_score(monetary, CAST(:monetary AS ARRAY<DOUBLE>), false) AS m_score
    FROM {metrics})
"""


def customer_segments_sql(
    spark: SparkSession, start: DateLike, end: DateLike | None = None, countries: Iterable[str] | None = None
) -> DataFrame:
    """The RFM table of the registered lines, by the SQL functions alone.

    The metrics are written once; the score thresholds come from them in a few
    small aggregates and are bound as parameters.
    """
    first, last = date_range(start, end)
    call = "SELECT * FROM customer_metrics(CAST(:first AS DATE), CAST(:last AS DATE), CAST(:countries AS ARRAY<STRING>))"
    args = {"first": first.isoformat(), "last": last.isoformat(), "countries": list(countries or [])}
    metrics = materialize(run_sql(spark, call, args), "customer-metrics")
    view = register(metrics, f"customer_metrics_{uuid.uuid4().hex}")
    try:
        return run_sql(spark, _SEGMENTS.format(metrics=view), score_thresholds(metrics))
    finally:
        spark.catalog.dropTempView(view)
