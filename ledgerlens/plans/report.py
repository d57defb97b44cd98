"""Page refresh job: every result the analytics page shows, for one filter.

    spark-submit --py-files ledgerlens.zip refresh_job.py --curated /curated/retail.parquet \
        --start 2010-12-01 --end 2011-12-09 --country "United Kingdom" --output /reports/run1

Reads the curated Parquet (or the current published version) once per result with the filter pushed to the
scan, and writes each (small) result as JSON lines under ``output``:
bounds, countries, kpis, monthly, markets, segments, segment_summary,
value_distribution, cohort_retention, cohort_matrix, products,
products_chart, quality, quality_signals.  The KPI row gates the rest: with
no matching valid sale only the metadata, KPI and quality results are
written, as the page stops there.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.filters import DateLike, date_range
from ..operators import cohort, quality, rfm, sales
from ..session import get_session, materialize
from .job import read_lines


# the page's results in order; without a matching sale it shows the gated ones only
ALL_RESULTS = [
    "bounds", "countries", "kpis", "monthly", "markets", "segments", "segment_summary",
    "value_distribution", "cohort_retention", "cohort_matrix", "products", "products_chart",
    "quality", "quality_signals",
]
GATED_RESULTS = ["bounds", "countries", "kpis", "quality", "quality_signals"]


def page_results(
    lines: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
    rollup: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """DataFrames of every page result for the filter.

    Missing ``start``/``end`` default to the data's date bounds (one small
    aggregate).  The invoice rollup, unless given, and the customer metrics
    are written to the shared folder when this function is called.
    """
    bounds = sales.date_bounds(lines)
    first_day, last_day = _bounds(lines, start, end)
    chosen = list(countries or [])
    valid = sales.filtered_sales(lines, first_day, last_day, chosen)
    rollup = materialize(sales.invoice_rollup(valid), "invoice-rollup") if rollup is None else rollup
    segments = rfm.rfm_segments(rfm.rfm_scores(rfm.rollup_metrics(rollup, last_day)))
    retention = cohort.cohort_retention(valid)
    filtered_quality = quality.quality_filtered(lines, first_day, last_day, chosen)
    return {
        "bounds": bounds,
        "countries": sales.country_options(lines),
        "kpis": sales.rollup_kpis(rollup),
        "monthly": sales.monthly_trend(valid),
        "markets": sales.top_markets(valid),
        "segments": segments,
        "segment_summary": rfm.segment_summary(segments),
        "value_distribution": rfm.value_distribution(segments),
        "cohort_retention": retention,
        "cohort_matrix": cohort.cohort_matrix(retention),
        "products": sales.top_products(valid),
        "products_chart": sales.top_products_chart(valid),
        "quality": filtered_quality,
        "quality_signals": quality.quality_signals(filtered_quality),
    }


def refresh_page(
    spark: SparkSession,
    curated_path: str,
    output: str,
    start: DateLike | None = None,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
) -> dict:
    """Write every page result under ``output``; return the KPI row."""
    lines = read_lines(spark, curated_path)
    first_day, last_day = _bounds(lines, start, end)
    chosen = list(countries or [])
    valid = sales.filtered_sales(lines, first_day, last_day, chosen)
    rollup = materialize(sales.invoice_rollup(valid), "invoice-rollup")
    kpis = sales.rollup_kpis(rollup)
    row = kpis.first()
    kpi_row = row.asDict()
    kpis = spark.createDataFrame([row], kpis.schema)
    if kpi_row["orders"]:
        results = page_results(lines, first_day, last_day, chosen, rollup) | {"kpis": kpis}
    else:
        filtered_quality = quality.quality_filtered(lines, first_day, last_day, chosen)
        results = {
            "bounds": sales.date_bounds(lines),
            "countries": sales.country_options(lines),
            "kpis": kpis,
            "quality": filtered_quality,
            "quality_signals": quality.quality_signals(filtered_quality),
        }
    for name, df in results.items():
        # every result is small (≤ customers for the per-customer feeds);
        # written by the executors, never collected
        df.write.mode("overwrite").json(f"{output.rstrip('/')}/{name}")
    return kpi_row


def _bounds(lines: DataFrame, start: DateLike | None, end: DateLike | None):
    """The filter's first and last day; missing ends come from the data."""
    if start is None or end is None:
        first = sales.date_bounds(lines).first()
        start = start or first["min_date"]
        end = end or first["max_date"]
    return date_range(start, end)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Refresh the analytics page results.")
    parser.add_argument("--curated", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--country", action="append", default=[])
    args = parser.parse_args(argv)
    spark = get_session()
    kpi = refresh_page(spark, args.curated, args.output, args.start, args.end, args.country)
    print(json.dumps(kpi, default=str, indent=2))


if __name__ == "__main__":
    main()
