"""The common lane gives what the full rules give, and is compiled as a whole; one parse per line."""

from __future__ import annotations

import random
import re

import pytest

from ledgerlens.operators import ingest
from ledgerlens.operators.ingest import KIND_PREFIX, RAW_HEADERS
from ledgerlens.plans.job import stage_landing
from ledgerlens.sources import landing

VALUES = ["source_period", "source_row", *ingest.VALUES, "error"]
CELLS = {
    "Quantity": ["6", "-12", "0", "-0", "007", "123456789", "1234567890", "99999999999", "1.0", "1.5", "+3", " 4", "4 ", "1_0", "x", "", None, "٣", "5\n", "--1"],
    "Price": ["2.55", "0", "-1.5", "1e3", "nan", "inf", ".5", "5.", "123456789012345.123456789012345", "1234567890123456", "1,5", "free", "", None, "2.5 ", "00.10", "3\n"],
    "InvoiceDate": [
        "2010-12-01 08:26:00", "2010-12-01T08:26:00", "2011-02-29 00:00:00", "2012-02-29 00:00:00", "2011-04-31 10:00:00", "2011-01-31 23:59:59", "2011-06-30 12:00:00",
        "2010-12-01 24:00:00", "2010-12-01 08:60:00", "0000-01-01 00:00:00", "0001-01-01 00:00:00", "9999-12-31 23:59:59", "2010-13-01 00:00:00", "2010-12-01", "20101201T0826",
        "2010-12-01 08:26", "2010-12-01 08:26:00.5", "2010-12-01 08:26:00Z", " 2010-12-01 08:26:00", "2010-12-01 08:26:00\n", "not a date", "", None,
    ],
    "Customer ID": ["17850", "17850.0", "17850.5", "", None, "  ", "-5", "123456789012345", "1234567890123456789", "nan", "abc", "12 ", "1e4", "17850\n"],
}


def _rows(n: int) -> list[tuple]:
    rng = random.Random(8)
    rows = []
    for i in range(n):
        cell = {h: rng.choice([c[0], c[0], rng.choice(c)]) for h, c in CELLS.items()}
        text = {h: rng.choice(["A1", " A1\t", "", None, "é'\""]) for h in ingest.TEXT_HEADERS}
        rows.append(("P", i + 2, *[(cell | text)[h] for h in RAW_HEADERS]))
    return rows


def _raw(spark, rows):
    fields = ", ".join(f"`{h}` string" for h in RAW_HEADERS)
    return spark.createDataFrame(rows, f"source_period string, source_row long, {fields}")


def _same(spark, raw):
    want = ingest.full_lane(raw, only_uncommon=False)
    got = ingest.normalise(raw)
    key = lambda r: (r.source_period, r.source_row)
    both = [sorted(df.select(VALUES).collect(), key=key) for df in (want, got.checked)]
    assert both[0] == both[1]
    lanes = ingest.common_lane(raw).unionByName(ingest.full_lane(raw))
    assert sorted(lanes.select(VALUES).collect(), key=key) == both[0]
    _, bad = ingest.split_checked(want)
    assert sorted(bad.collect(), key=key) == sorted(got.quarantine.collect(), key=key)
    return want, got


def test_both_lanes_give_what_the_full_rules_give(spark):
    raw = _raw(spark, _rows(4000))
    want, got = _same(spark, raw)
    common = raw.where(ingest._is_common())
    assert 400 < common.count() < 3600
    assert got.counters.get["source_rows"] == 4000


def test_every_single_cell_form(spark):
    base = {h: c[0] for h, c in CELLS.items()} | {h: "A1" for h in ingest.TEXT_HEADERS}
    cells = [base | {h: v} for h, values in CELLS.items() for v in values]
    _same(spark, _raw(spark, [("P", i + 2, *[c[h] for h in RAW_HEADERS]) for i, c in enumerate(cells)]))


def test_the_job_reads_the_landing_rows_once_and_gives_the_same(spark, tmp_path):
    raw = _raw(spark, _rows(1500))
    want = ingest.full_lane(raw, only_uncommon=False)
    staged, quarantine, counters = stage_landing(raw, str(tmp_path / "checked"))
    good, bad = ingest.split_checked(want)
    key = lambda r: r.source_row
    assert sorted(staged.select(good.columns).collect(), key=key) == sorted(good.collect(), key=key)
    assert sorted(quarantine.collect(), key=key) == sorted(bad.collect(), key=key)
    assert counters == {"source_rows": 1500, "staged_rows": good.count(), "quarantined_rows": bad.count()}


def test_cells_with_json_types(spark):
    rows = [(*r, *["text"] * 8) for r in _rows(300)]
    kinds = ", ".join(f"`{KIND_PREFIX}{h}` string" for h in RAW_HEADERS)
    fields = ", ".join(f"`{h}` string" for h in RAW_HEADERS)
    rows += [("P", 900, "1", "s", "d", "True", "2010-12-01 08:26:00", "2.0", "5", "F", *["text"] * 3, "bool", *["text"] * 4)]
    _same(spark, spark.createDataFrame(rows, f"source_period string, source_row long, {fields}, {kinds}"))


def _method_sizes(df, capsys) -> list[int]:
    df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


@pytest.mark.parametrize("lane", [ingest.common_lane, ingest.first_pass])
def test_the_common_lane_is_small_enough_for_the_jit(spark, tmp_path, capsys, lane):
    _raw(spark, _rows(5)).write.parquet(str(tmp_path / "raw"))
    sizes = _method_sizes(lane(spark.read.parquet(str(tmp_path / "raw"))), capsys)
    assert sizes and max(sizes) < 8000


def test_each_line_is_parsed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = dict(zip(RAW_HEADERS, ["1", "s", "d", "6", "2010-12-01 08:26:00", "2.55", "17850", "France"]))
    for k, headers in enumerate((RAW_HEADERS, RAW_HEADERS[::-1], RAW_HEADERS[3:] + RAW_HEADERS[:3])):
        (folder / f"{k}.csv").write_text("\n".join([",".join(headers), ",".join(line[h] for h in headers)]) + "\n")
    rows = landing.read_landing(spark, {"P": str(folder)})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1
    assert {tuple(r[h] for h in RAW_HEADERS) for r in rows.collect()} == {tuple(line.values())}


def test_the_split_index_is_kept_and_counted_by_file(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    for k in range(5):
        lines = [",".join(RAW_HEADERS)] + [f"{k}-{i},s,d,6,2010-12-01 08:26:00,2.55,17850,F" for i in range(40 + k)]
        (folder / f"{k}.csv").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    try:
        tagged = landing.tag_rows(spark.read.text(str(folder)))
        plan = landing.split_index(tagged, headers=True)._jdf.queryExecution().executedPlan().toString()
        # only the files' totals come together
        assert plan.count("SinglePartition") <= 1
        read = lambda: landing.read_landing(spark, {"P": str(folder)}, index_dir=index)
        want = [(r, f"{k}-{i}") for r, (k, i) in enumerate(((k, i) for k in range(5) for i in range(40 + k)), 2)]
        for _ in range(2):
            rows = read()
            assert sorted((r.source_row, r.Invoice) for r in rows.select("source_row", "Invoice").collect()) == want
            # the index is read, not computed: no aggregate over lines
            assert "min(_ln_id" not in rows._jdf.queryExecution().optimizedPlan().toString()
        names = lambda: {str(p) for p in (tmp_path / "index").rglob("*.json")}
        kept = names()
        assert len(kept) == 1
        (folder / "9.csv").write_text(",".join(RAW_HEADERS) + "\nlast,s,d,6,2010-12-01 08:26:00,2.55,17850,F\n")
        assert sorted((r.source_row, r.Invoice) for r in read().collect())[-1] == (len(want) + 2, "last")
        assert len(names()) == 2
    finally:
        spark.conf.set(key, before)
