"""Landing files of one period: own headers, blank rows, reruns, unfinished folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ingest import RAW_HEADERS
from ledgerlens.plans.datasets import ensure_dataset
from ledgerlens.plans.job import build_dataset, output_paths
from ledgerlens.sources import landing
from ledgerlens.sources.fixtures import landing_files
from ledgerlens.sources.landing import read_landing
from ledgerlens.streaming.ingest import start_ingest_stream

ROW = dict(zip(RAW_HEADERS, ["536365", "85123A", "HOLDER", "6", "2010-12-01 08:26:00", "2.55", "17850", "France"]))


def _write(path, headers, rows):
    lines = [",".join(headers)] + [",".join(r.get(h, "") for h in headers) if r else "" for r in rows]
    path.write_text("\n".join(lines) + "\n")


def _folder(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    _write(folder / "a.csv", RAW_HEADERS, [ROW, None, ROW])
    _write(folder / "b.csv", RAW_HEADERS[::-1], [ROW | {"Price": "7", "Quantity": "3"}])
    return folder


def test_each_file_is_bound_by_its_own_header(spark, tmp_path):
    rows = read_landing(spark, {"P": str(_folder(tmp_path))}).orderBy("source_row").collect()
    assert [(r.source_row, r.Quantity, r.Price) for r in rows] == [(2, "6", "2.55"), (3, None, None), (4, "6", "2.55"), (5, "3", "7")]


def test_a_wrong_header_in_a_later_file_fails_with_its_name(spark, tmp_path):
    folder = _folder(tmp_path)
    _write(folder / "c.csv", [*RAW_HEADERS[:-1], "Nation"], [ROW])
    with pytest.raises(ValueError, match=r"sheet 'P'.*c\.csv"):
        read_landing(spark, {"P": str(folder)})


def test_the_stream_binds_by_name_and_rejects_wrong_headers(spark, tmp_path):
    folder = _folder(tmp_path)
    where = [str(tmp_path / n) for n in ("out", "bad", "state")]
    start_ingest_stream(spark, str(folder), *where, period="P", available_now=True).awaitTermination()
    found = sorted((r.quantity, r.unit_price) for r in spark.read.parquet(where[0]).collect())
    assert found == [(3, 7.0), (6, 2.55), (6, 2.55)]
    _write(folder / "c.csv", [*RAW_HEADERS[:-1], "Nation"], [ROW])
    with pytest.raises(Exception, match="Unexpected columns"):
        start_ingest_stream(spark, str(folder), *where, period="P", available_now=True).awaitTermination()


def test_a_clean_rerun_removes_the_old_quarantine_and_scratch(spark, tmp_path):
    folder, output = _folder(tmp_path), str(tmp_path / "curated.parquet")
    before = set(os.listdir(_checkpoints(spark)))
    report = build_dataset(spark, {"P": str(folder)}, output).first()
    assert (report.source_rows, report.quarantined_rows) == (4, 1)
    quarantine = output_paths(output)["quarantine"]
    assert "Quantity must be numeric, got None" in spark.read.option("header", "true").csv(quarantine).first().error
    _write(folder / "a.csv", RAW_HEADERS, [ROW])
    assert build_dataset(spark, {"P": str(folder)}, output).first().quarantined_rows == 0
    assert not os.path.exists(quarantine)
    assert set(os.listdir(_checkpoints(spark))) == before


def _checkpoints(spark):
    return spark.sparkContext.getCheckpointDir().removeprefix("file:")


def test_an_unfinished_folder_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(25).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert ensure_dataset(spark, path, lambda: spark.range(100)).count() == 100
    assert ensure_dataset(spark, path, lambda: spark.range(7)).count() == 100


def test_the_split_index_sorts_no_lines(spark, tmp_path):
    tagged = landing.tag_rows(spark.read.text(str(_folder(tmp_path))))
    index = landing.split_index(tagged, headers=True)
    assert "SortAggregate" not in index._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r._ln_f.rsplit("/", 1)[1], r._ln_rows, r._ln_before, r._ln_header) for r in index.collect())
    assert rows == [("a.csv", 4, 0, ",".join(RAW_HEADERS)), ("b.csv", 2, 3, ",".join(RAW_HEADERS[::-1]))]


def test_the_fixture_files_are_compressed_and_read_back_whole(spark, tmp_path):
    cells = [F.concat(F.lit(f"{h} "), "id").alias(h) for h in RAW_HEADERS]
    rows = spark.range(500).select(F.concat(F.lit("Year "), F.col("id") % 3).alias("source_period"), (F.col("id") / 3).cast("long").alias("n"), "id", *cells)
    rows = rows.select("source_period", (F.col("n") + 2).alias("source_row"), *RAW_HEADERS)
    files = landing_files(spark, rows)
    assert all(n.endswith(".gz") for p in files.values() for n in os.listdir(p.removeprefix("file:")) if n.startswith("part-"))
    back = read_landing(spark, files).select(*rows.columns)
    assert back.count() == 500 and back.exceptAll(rows).count() == 0
