"""Page refresh job writes every result, and stops after the KPIs when empty."""

from __future__ import annotations

import os

from ledgerlens.plans.datasets import write_curated
from ledgerlens.plans.report import refresh_page
from ledgerlens.sources.fixtures import retail_lines


def test_refresh_page_writes_all_results(spark, sf_small, tmp_path):
    curated = str(tmp_path / "curated")
    write_curated(retail_lines(spark, sf_small, with_line_id=True), curated)
    out = str(tmp_path / "page")
    kpi = refresh_page(spark, curated, out, "1996-01-01", "1998-12-31", ["NATION_1", "NATION_2"])
    assert kpi["orders"] > 0
    written = sorted(os.listdir(out))
    assert "cohort_matrix" in written and "segments" in written and len(written) == 14
    months = spark.read.json(f"{out}/monthly").count()
    assert 0 < months <= 36

    empty = str(tmp_path / "empty")
    kpi = refresh_page(spark, curated, empty, "1996-01-01", "1998-12-31", ["NO_SUCH"])
    assert kpi["orders"] == 0 and kpi["repeat_customer_pct"] == 0.0
    assert sorted(os.listdir(empty)) == sorted(["bounds", "countries", "kpis", "quality", "quality_signals"])


def test_refresh_page_defaults_to_data_bounds(spark, sf_small, tmp_path):
    curated = str(tmp_path / "curated_all")
    write_curated(retail_lines(spark, sf_small, with_line_id=True), curated)
    kpi = refresh_page(spark, curated, str(tmp_path / "page_all"))
    assert kpi["orders"] > 0
