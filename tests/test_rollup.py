"""The stored rollup: merged batches equal a full rebuild; failed and repeated merges change nothing."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from ledgerlens.operators import rfm, sales
from ledgerlens.plans import rollup, versions

LINES = "invoice_no string, customer_id long, country string, invoice_timestamp timestamp_ntz, line_revenue double, is_valid_sale boolean"
FILTERS = [("2011-01-01", "2011-12-31", None), ("2011-03-05", "2011-07-20", ["France", "Spain"]), ("2011-02-03", None, None), ("2001-01-01", None, None)]


def _lines(spark, seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # an invoice can have lines in several batches, days, countries and of several customers
        at = dt.datetime(2011, rng.randint(1, 12), rng.choice([1, 3, 5, 20, 28]), rng.randint(0, 23), 59, 59)
        customer = rng.choice([None, *range(40)])
        rows.append((rng.choice([None, *map(str, range(300))]), customer, rng.choice(["France", "Spain", "", None]), None if rng.random() < 0.02 else at,
                     None if rng.random() < 0.02 else round(rng.uniform(0.01, 90), 2), rng.choice([True, True, True, False, None])))
    return spark.createDataFrame(rows, LINES)


def _same(state, lines, chosen):
    start, end, countries = chosen
    part, slice_ = rollup.state_slice(state, start, end, countries), sales.filtered_sales(lines, start, end, countries)
    for got, want in (
        (rollup.state_kpis(part), sales.kpi_summary(slice_)),
        (rollup.state_trend(part), sales.monthly_trend(slice_)),
        (rollup.state_markets(part, 3), sales.top_markets(slice_, 3)),
        (rollup.state_metrics(part, "2012-01-01").orderBy("customer_id"), rfm.customer_metrics(slice_, "2012-01-01").orderBy("customer_id")),
    ):
        assert got.schema.simpleString() == want.schema.simpleString()
        assert got.collect() == want.collect()


def test_merged_batches_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup, "MOST_SEGMENTS", 2)
    root, batches = str(tmp_path / "rollup"), [_lines(spark, k, 500) for k in range(4)]
    with pytest.raises(FileNotFoundError):
        rollup.read_state(spark, root)
    for k, lines in enumerate(batches):
        version = rollup.merge_batch(spark, root, f"load-{k}", lines)
        assert rollup.merge_batch(spark, root, f"load-{k}", lines) == version
    assert version.notes["batches"] == [f"load-{k}" for k in range(4)] and len(version.notes["segments"]) == 2
    every = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3]).persist()
    for chosen in FILTERS:
        _same(rollup.read_state(spark, root), every, chosen)
    # what the current commit does not name can go
    assert rollup.expire_segments(spark, root) == [1, 2, 3] and len(os.listdir(f"{root}/versions")) == 2
    _same(rollup.read_state(spark, root), every, FILTERS[0])


def test_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    root, lines = str(tmp_path / "rollup"), _lines(spark, 9, 200)
    before = rollup.merge_batch(spark, root, "a", lines)

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        rollup.merge_batch(spark, root, "b", lines)
    monkeypatch.undo()
    assert versions.current(spark, root) == before
    _same(rollup.read_state(spark, root), lines, FILTERS[0])
    assert rollup.merge_batch(spark, root, "b", lines).number == 2


def test_filters_reach_the_scan(spark, tmp_path):
    root = str(tmp_path / "rollup")
    rollup.merge_batch(spark, root, "a", _lines(spark, 1, 300))
    kpis = rollup.state_kpis(rollup.state_slice(rollup.read_state(spark, root), "2011-03-05", "2011-07-20", ["France", "Spain"]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = kpis._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(day" in pushed and "LessThanOrEqual(day" in pushed and "In(country" in pushed
