"""Steps of the build job: each does its work once, in place, with the results of the plain way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ingest, ranking
from ledgerlens.plans import datasets, manifest
from ledgerlens.session import COMPILED_BYTES, smaller_methods
from ledgerlens.sources import fixtures, landing

def _staged(spark, rows):
    return rows.select(
        F.lit("p").alias("source_period"),
        F.col("id").alias("source_row"),
        F.concat(F.when(F.col("id") % 3 == 0, "C").otherwise(""), F.col("id").cast("string")).alias("invoice_no"),
        F.lit("s").alias("stock_code"),
        F.lit(None).cast("string").alias("description"),
        (F.col("id") % 5).cast("int").alias("quantity"),
        F.timestamp_add("DAY", -F.col("id").cast("int"), F.lit("2001-01-01 08:26:00").cast("timestamp_ntz")).alias("invoice_timestamp"),
        F.lit(2.5).alias("unit_price"),
        F.col("id").alias("customer_id"),
        F.lit("X").alias("country"),
    )


@pytest.mark.parametrize("mark_rows", [1 << 18, 0])
@pytest.mark.parametrize("repeated", [False, True])
def test_rows_are_dealt_out_before_their_ids_are_added(spark, monkeypatch, mark_rows, repeated):
    monkeypatch.setattr(ranking, "MARK_ROWS", mark_rows)
    rows = spark.range(5, 9000, 2)
    staged = _staged(spark, rows.union(rows.limit(1)) if repeated else rows)
    dealt = []

    def deal(lines):
        dealt.append(lines.columns)
        return datasets.dealt_for_write(lines, F.lit(7) - F.col("quantity"))

    lines = ingest.curate(staged, deal=deal)
    assert lines.columns[-1] == datasets.CLUSTER
    assert len(dealt) == 1
    assert ("transaction_line_id" in dealt[0]) == (repeated or not mark_rows)
    plain = ingest.curate(staged).drop("transaction_line_id") if repeated else ingest.curate(staged)
    found = lines.select(*plain.columns)
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert sorted(r[0] for r in lines.select("transaction_line_id").collect()) == list(range(1, staged.count() + 1))


def test_dealt_rows_are_written_in_ranges(spark, tmp_path):
    staged = _staged(spark, spark.range(20_000))
    lines = ingest.curate(staged, deal=lambda rows: datasets.dealt_by_range(rows, ["invoice_timestamp"], 9 * ranking.SORT_ROWS))
    datasets.write_curated(lines, str(tmp_path / "lines"))
    files = spark.read.parquet(str(tmp_path / "lines")).groupBy(F.input_file_name()).agg(
        F.min("invoice_timestamp").alias("low"), F.max("invoice_timestamp").alias("high")
    )
    spans = sorted((r.low, r.high) for r in files.collect())
    assert len(spans) > 1
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_date_parts_compare_the_timestamp_itself(spark):
    staged = _staged(spark, spark.range(4000))
    cells = staged.select("invoice_timestamp", manifest.curve_cells(staged).alias("cell"))
    assert "as date" not in cells._jdf.queryExecution().optimizedPlan().toString()
    days = cells.groupBy(F.to_date("invoice_timestamp")).agg(F.count_distinct("cell").alias("n"))
    assert days.where("n > 1").isEmpty()
    assert cells.select("cell").distinct().count() > 10


def test_texts_need_no_kinds_in_the_first_pass(spark):
    raw = spark.createDataFrame(
        [("p", 2, "1", "s", "d", "bad", "2001-01-01 08:26:00", "1", "7", "X")],
        ["source_period", "source_row", *ingest.RAW_HEADERS],
    )
    first = ingest.first_pass(raw)
    assert not [c for c in first.columns if c.startswith(ingest.KIND_PREFIX)]
    checked = ingest.common_part(first).unionByName(ingest.second_pass(first))
    assert ingest.split_checked(checked)[1].first().raw_values == "('1', 's', 'd', 'bad', '2001-01-01 08:26:00', '1', '7', 'X')"


def test_landing_files_hold_stretches_of_a_period_in_order(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "SORT_ROWS", 100)
    rows = spark.range(2, 1002).select(
        F.when(F.col("id") < 700, "Year 1995").otherwise("Year 1996").alias("source_period"),
        F.when(F.col("id") < 700, F.col("id")).otherwise(F.col("id") - 698).alias("source_row"),
        *[F.concat(F.lit(f"{h[0]} "), F.col("id").cast("string")).alias(h) for h in ingest.RAW_HEADERS],
    )
    files = fixtures.landing_files(spark, rows)
    for period, path in files.items():
        sizes = spark.read.option("header", "true").csv(path).groupBy(F.input_file_name()).count().collect()
        assert len(sizes) == (7 if period == "Year 1995" else 4)
        assert max(r["count"] for r in sizes) <= 100
    read = landing.read_landing(spark, files).select("source_period", "source_row", *ingest.RAW_HEADERS)
    assert read.exceptAll(rows).isEmpty() and rows.exceptAll(read).isEmpty()


def test_the_method_limit_is_put_back(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with smaller_methods(spark):
        assert spark.conf.get(key) == str(COMPILED_BYTES)
    assert spark.conf.get(key) == before
