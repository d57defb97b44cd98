"""File manifest of a published table: bounds, options and file skipping without reading data.

Curated lines are laid out along a space-filling curve of date and country, so
that a file covers a short date range of few countries.  The manifest, written
with each version, has one row per file: rows, first and last timestamp, and the
distinct countries.  It answers the date bounds and the country list, and it
tells which files a filter needs: the others are not even opened.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import DateLike, date_range, non_blank

CELL_BITS = 4  # 16 date parts by 16 country parts
MOST_COUNTRIES = 10_000  # beyond so many, countries are dealt to parts by hash

MANIFEST_COLUMNS = ["file", "rows", "first_timestamp", "last_timestamp", "countries", "without_country"]


def curve_cells(lines: DataFrame) -> Column:
    """The place of a line on the curve: bits of its date part and country part, in turn.

    Parts hold about equally many lines each.  Two small aggregates over
    ``lines`` find their bounds, which decide the layout only, never a result.
    """
    parts = 1 << CELL_BITS
    at = F.col("invoice_timestamp")
    shares = [i / parts for i in range(1, parts)]
    found = lines.agg(F.percentile_approx(at, shares, 1000).alias("times")).first()["times"] or []
    # whole days, as bounds of the timestamp: a row's own date would be slower to find
    days = [F.lit(dt.datetime.combine(t.date(), dt.time.min).isoformat(sep=" ")).cast("timestamp_ntz") for t in found]
    counts = lines.groupBy("country").count().orderBy("country").limit(MOST_COUNTRIES + 1).collect()
    if len(counts) > MOST_COUNTRIES:
        country_part = F.pmod(F.xxhash64("country"), F.lit(parts)).cast("int")
    else:
        total, seen, starts = sum(r["count"] for r in counts), 0, []
        for r in counts:
            if r["country"] is not None and seen * parts // max(total, 1) > len(starts):
                starts += [r["country"]] * (seen * parts // total - len(starts))
            seen += r["count"]
        country_part = _part_after(F.col("country"), starts)
    date_part = _part_after(at, days)
    cell = F.lit(0)
    for bit in range(CELL_BITS):
        for own, place in ((date_part, 2 * bit + 1), (country_part, 2 * bit)):
            cell = cell + F.shiftleft(F.shiftright(own, bit).bitwiseAND(F.lit(1)), place)
    return cell


def _part_after(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``; 0 for NULL."""
    out = F.lit(0)
    for i, bound in enumerate(bounds, 1):
        out = F.when(value >= F.lit(bound), F.lit(i)).otherwise(out)
    return out


def write_manifest(spark: SparkSession, table: str, path: str) -> None:
    """One row for each file of the Parquet table, from one pass over two columns."""
    lines = spark.read.parquet(table)
    files = lines.select(F.col("_metadata.file_name").alias("file"), "invoice_timestamp", "country").groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("invoice_timestamp").alias("first_timestamp"),
        F.max("invoice_timestamp").alias("last_timestamp"),
        F.array_sort(F.collect_set("country")).alias("countries"),
        F.count_if(F.col("country").isNull()).alias("without_country"),
    )
    files.coalesce(1).write.parquet(path)


def manifest_bounds(manifest: DataFrame) -> DataFrame:
    """``min_date, max_date`` of the whole table (C4)."""
    return manifest.agg(F.to_date(F.min("first_timestamp")).alias("min_date"), F.to_date(F.max("last_timestamp")).alias("max_date"))


def manifest_countries(manifest: DataFrame) -> DataFrame:
    """Sorted distinct non-blank countries of the whole table (C5)."""
    return manifest.select(F.explode("countries").alias("country")).where(non_blank("country")).distinct().orderBy("country")


def needed_files(
    manifest: DataFrame, start: DateLike | None = None, end: DateLike | None = None, countries: Iterable[str] | None = None
) -> list[str]:
    """Files that can hold a line of the filter; missing parts of the filter keep all files.

    The driver gets file names, as it does when it lists a table.
    """
    kept = manifest
    if start is not None:
        first, last = date_range(start, end)
        low = dt.datetime.combine(first, dt.time.min).isoformat(sep=" ")
        high = dt.datetime.combine(last + dt.timedelta(days=1), dt.time.min).isoformat(sep=" ")
        kept = kept.where((F.col("last_timestamp") >= F.lit(low).cast("timestamp_ntz")) & (F.col("first_timestamp") < F.lit(high).cast("timestamp_ntz")))
    chosen = list(countries or [])
    if chosen:
        kept = kept.where(F.arrays_overlap("countries", F.array(*[F.lit(c) for c in chosen])))
    return sorted(r.file for r in kept.select("file").collect())


def read_needed(
    spark: SparkSession,
    table: str,
    manifest: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """The lines of the files that the filter needs; the filter itself is still to be applied."""
    schema = spark.read.parquet(table).schema
    files = needed_files(manifest, start, end, countries)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table.rstrip('/')}/{f}" for f in files])
