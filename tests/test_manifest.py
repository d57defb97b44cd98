"""Published files: the layout by date and country, the manifest, and the files it spares."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import sales
from ledgerlens.operators.ingest import RAW_HEADERS
from ledgerlens.plans import datasets, job, manifest


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("published")
    rng = random.Random(3)
    countries = ["United Kingdom"] * 30 + [f"Country {k:02d}" for k in range(30)] + [""]
    lines = [",".join(RAW_HEADERS)]
    for i in range(6000):
        month, day = rng.randint(1, 12), rng.randint(1, 28)
        lines.append(f"{i},S{i % 50},thing,{rng.randint(1, 9)},2011-{month:02d}-{day:02d} 10:00:00,2.5,{i % 400},{rng.choice(countries)}")
    (folder / "in").mkdir()
    (folder / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():  # tiny input: AQE would merge it into one file
        spark.conf.set(k, v)
    try:
        job.publish_dataset(spark, {"P": str(folder / "in")}, str(folder / "retail"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return str(folder / "retail")


def test_the_manifest_has_every_file_and_row(spark, root):
    rows = job.read_manifest(spark, root).collect()
    lines = job.read_lines(spark, root)
    assert set(rows[0].asDict()) == set(manifest.MANIFEST_COLUMNS)
    assert sum(r.rows for r in rows) == lines.count() == 6000 and len(rows) >= 30
    assert sum(r.without_country for r in rows) == lines.where("country is null").count() > 0
    for r in rows:
        own = lines.where(F.col("_metadata.file_name") == r.file)
        low, high = own.agg(F.min("invoice_timestamp"), F.max("invoice_timestamp")).first()
        assert (r.first_timestamp, r.last_timestamp) == (low, high)
        assert r.countries == sorted(x.country for x in own.where("country is not null").select("country").distinct().collect())
        break


def test_bounds_and_countries_read_no_data(spark, root):
    files, lines = job.read_manifest(spark, root), job.read_lines(spark, root)
    for got, want in (
        (manifest.manifest_bounds(files), sales.date_bounds(lines)),
        (manifest.manifest_countries(files), sales.country_options(lines)),
    ):
        assert got.collect() == want.collect()
        assert job.TABLE not in " ".join(got.inputFiles())


@pytest.mark.parametrize(
    "start,end,countries,most",
    [("2011-01-01", "2011-12-31", ["Country 07"], 0.35), ("2011-03-01", "2011-03-20", [], 0.4), ("2011-03-01", "2011-03-20", ["Country 21", "Country 22"], 0.15)],
)
def test_a_filter_opens_few_files_and_loses_no_line(spark, root, start, end, countries, most):
    lines, some = job.read_lines(spark, root), job.read_lines(spark, root, start, end, countries)
    want = sales.filtered_sales(lines, start, end, countries)
    got = sales.filtered_sales(some, start, end, countries)
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert len(some.inputFiles()) <= most * len(lines.inputFiles())


def test_a_filter_without_files(spark, root):
    none = job.read_lines(spark, root, "1999-01-01", "1999-01-02")
    assert none.count() == 0 and none.schema == job.read_lines(spark, root).schema
    assert job.read_lines(spark, root, countries=["Nowhere"]).count() == 0


def test_many_countries_are_dealt_by_hash(spark, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_COUNTRIES", 3)
    df = spark.createDataFrame([(f"c{i}", f"2011-01-{1 + i % 28:02d}") for i in range(200)], "country string, d string")
    cells = df.withColumn("invoice_timestamp", F.col("d").cast("timestamp_ntz"))
    values = {r.c for r in cells.select(manifest.curve_cells(cells).alias("c")).collect()}
    assert len(values) > 60 and max(values) < 256


def test_no_lines(spark, root):
    none = job.read_lines(spark, root).where("false")
    assert none.select(manifest.curve_cells(none)).count() == 0


def test_the_layout_is_computed_once_for_each_line(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(f"c{i % 9}", f"2011-01-{1 + i % 28:02d}") for i in range(300)], "country string, d string")
    lines = lines.select("country", F.col("d").cast("timestamp_ntz").alias("invoice_timestamp"))
    sorts = []
    real = datasets.dealt_by_range
    monkeypatch.setattr(datasets, "dealt_by_range", lambda df, keys, rows=None: (sorts.append((df.columns, keys)), real(df, keys, rows))[1])
    datasets.write_curated(lines, str(tmp_path / "t"), cluster=manifest.curve_cells(lines))
    (columns, keys), = sorts
    assert all(isinstance(k, str) and k in columns for k in keys)  # a sort compares columns, not expressions
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == lines.columns and back.exceptAll(lines).count() == 0 and back.count() == 300
