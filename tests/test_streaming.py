"""The streaming ingest gives the batch job's rows, ids dense across batches."""

from __future__ import annotations

import os

from test_reference_cases import PERIOD, ROWS, _write_csv

from ledgerlens.streaming.ingest import start_ingest_stream


def _drop(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    tmp = _write_csv(folder + "_tmp_" + name, rows=rows)
    os.rename(os.path.join(tmp, "part-0.csv"), os.path.join(folder, f"{name}.csv"))


def test_stream_ingest_matches_batch_and_keeps_ids_dense(spark, tmp_path):
    landing = str(tmp_path / "landing")
    out, bad, ckpt = str(tmp_path / "curated"), str(tmp_path / "quarantine"), str(tmp_path / "ckpt")
    _drop(landing, "a", ROWS[:4])
    q = start_ingest_stream(spark, landing, out, bad, ckpt, period=PERIOD, available_now=True)
    q.awaitTermination(120)
    first = spark.read.parquet(out).orderBy("transaction_line_id").collect()
    assert [r["invoice_no"] for r in first] == ["700101", "C700102", "700103"]
    assert [r["transaction_line_id"] for r in first] == [1, 2, 3]

    _drop(landing, "b", ROWS[:3] + ROWS[5:])
    q = start_ingest_stream(spark, landing, out, bad, ckpt, period=PERIOD, available_now=True)
    q.awaitTermination(120)
    lines = spark.read.parquet(out).orderBy("transaction_line_id").collect()
    assert [r["transaction_line_id"] for r in lines] == [1, 2, 3, 4, 5, 6]
    assert [r["invoice_no"] for r in lines][3:] == ["700101", "C700102", "700103"]
    quarantined = spark.read.option("header", "true").csv(bad).collect()
    assert sorted((r["source_row"], r["error"].split(",")[0]) for r in quarantined) == [
        ("5", "Customer ID must be numeric"),
        ("5", "Quantity must be numeric"),
        ("6", "Price must be finite"),
    ]


def test_stream_ingest_reads_json_lines(spark, tmp_path):
    from test_reference_cases import _write_json

    landing = _write_json(str(tmp_path / "landing_json"))
    out, bad, ckpt = str(tmp_path / "c"), str(tmp_path / "q"), str(tmp_path / "k")
    q = start_ingest_stream(spark, landing, out, bad, ckpt, period=PERIOD, available_now=True, fmt="json")
    q.awaitTermination(120)
    lines = spark.read.parquet(out).orderBy("transaction_line_id").collect()
    assert [r["invoice_no"] for r in lines] == ["700101", "C700102", "700103"]
    assert spark.read.option("header", "true").csv(bad).count() == 4
