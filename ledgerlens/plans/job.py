"""End-to-end build job: landing files → curated Parquet + quarantine + report.

    spark-submit --py-files ledgerlens.zip build_job.py \
        --input "Year 2009-2010=s3://bucket/landing/2009" \
        --input "Year 2010-2011=s3://bucket/landing/2010" \
        --output s3://bucket/curated/retail_transactions.parquet

Passes over the data: (1) read + number every landing row once, type the rows
in common form, run the full rules over the others, and write the checked rows
to the shared checkpoint folder; (2) number and flag the staged
rows and write the curated ZSTD Parquet; (3) write the quarantined rows as
CSV when there are any; (4) a column-pruned aggregate over the curated
output for the quality report, written as one JSON object.

The outputs replace those of an earlier build only when all of them are whole;
``--versioned`` keeps versions with a commit pointer instead (see ``versions``).
"""

from __future__ import annotations

import argparse
import json
import os
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import DateLike
from ..operators.ingest import common_part, curate, first_pass, second_pass, split_checked
from ..operators.quality import quality_summary
from ..session import delete_path, get_session, path_exists, scratch_path, smaller_methods
from ..sources.landing import read_landing
from .datasets import dealt_for_write, write_curated
from .manifest import curve_cells, read_needed, write_manifest
from .versions import Version, current, input_digest, publish, replace_path

TABLE = "lines.parquet"  # the curated table's name inside a version
REPORT_COUNTERS = ["source_rows", "staged_rows", "quarantined_rows"]


def output_paths(output: str) -> dict[str, str]:
    """Sibling paths of the curated output: quarantine CSV and report JSON."""
    stem = output.rstrip("/")
    if stem.endswith(".parquet"):
        stem = stem[: -len(".parquet")]
    return {
        "curated": output.rstrip("/"),
        "quarantine": f"{stem}.quarantine.csv",
        "report": f"{stem}.quality.json",
    }


def stage_landing(raw: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Validate landing rows once; return (staged, quarantine, run counters).

    The landing rows are read and parsed in one pass, which types the rows in
    common form and keeps the cells of the others.  The full rules run over those
    others only.  Both results are written to the shared checkpoint folder, so
    the staged rows, the quarantine and the id offsets read them instead of
    validating again.
    """
    spark = raw.sparkSession
    path = path or scratch_path(spark, "checked")
    first_pass(raw).write.mode("overwrite").parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    with smaller_methods(spark):
        second_pass(first).write.mode("overwrite").parquet(f"{path}/second")
    checked = common_part(first).unionByName(spark.read.parquet(f"{path}/second"))
    staged, quarantine = split_checked(checked)
    bad = F.col("error").isNotNull()
    counted = checked.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(~bad).alias("staged_rows"), F.count_if(bad).alias("quarantined_rows"))
    return staged, quarantine, counted.first().asDict()


def _items(sources: Mapping[str, str] | Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return list(sources.items()) if isinstance(sources, Mapping) else list(sources)


def _write_outputs(
    spark: SparkSession,
    items: list[tuple[str, str]],
    paths: Mapping[str, str],
    fmt: str,
    options: Mapping[str, str] | None,
    source_name: str | None,
    output_name: str,
    index_dir: str | None = None,
) -> DataFrame:
    """Write the three outputs to ``paths``, which are new; the report."""
    scratch = scratch_path(spark, "checked")
    try:
        raw = read_landing(spark, items, fmt, options, index_dir or f"{scratch}-splits")
        staged, quarantine, counters = stage_landing(raw, scratch)  # pass 1
        layout = curve_cells(staged) if "manifest" in paths else True
        lines = curate(staged, scratch, lambda rows: dealt_for_write(rows, layout, rows=counters["staged_rows"]))
        write_curated(lines, paths["curated"])  # pass 2
        if "manifest" in paths:
            write_manifest(spark, paths["curated"], paths["manifest"])
        if counters.get("quarantined_rows", 0) > 0:  # pass 3
            with smaller_methods(spark):
                quarantine.write.option("header", "true").csv(paths["quarantine"])
    finally:
        delete_path(spark, scratch)
        delete_path(spark, f"{scratch}-splits")

    summary = quality_summary(spark.read.parquet(paths["curated"]))  # pass 4
    name = source_name or ",".join(os.path.basename(p.rstrip("/")) for _, p in items)
    report = summary.select(
        "*",
        *[F.lit(int(counters.get(c, 0))).cast("bigint").alias(c) for c in REPORT_COUNTERS],
        F.lit(name).alias("source_workbook"),
        F.lit(output_name).alias("output_parquet"),
    )
    # one row: a single output task is the whole report, not a data bottleneck;
    # timestamps as Python prints them ("2010-12-01 08:26:00")
    report = spark.createDataFrame(report.collect(), report.schema).coalesce(1)
    report.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(paths["report"])
    return report


def build_dataset(
    spark: SparkSession,
    sources: Mapping[str, str] | Iterable[tuple[str, str]],
    output: str,
    fmt: str = "csv",
    options: Mapping[str, str] | None = None,
    source_name: str | None = None,
) -> DataFrame:
    """Build the curated dataset and return its one-row quality report.

    Report columns: the nine quality measures, ``source_rows``,
    ``staged_rows``, ``quarantined_rows``, ``source_workbook`` (the landing
    source names) and ``output_parquet``, as in the reference's report.

    All outputs are written beside their places first and moved there when the
    whole build has succeeded; a build that fails leaves the outputs of the one
    before.  ``publish_dataset`` is for tables that are read while they are rebuilt.
    """
    paths = output_paths(output)
    mark = f".building-{uuid.uuid4().hex}"
    written = {name: path + mark for name, path in paths.items()}
    try:
        name = os.path.basename(paths["curated"])
        report = _write_outputs(spark, _items(sources), written, fmt, options, source_name, name)
        for name, path in paths.items():
            if path_exists(spark, written[name]):
                replace_path(spark, written[name], path)
            else:
                delete_path(spark, path)  # an earlier run's quarantine
    finally:
        for path in written.values():
            delete_path(spark, path)
    return report


def publish_dataset(
    spark: SparkSession,
    sources: Mapping[str, str] | Iterable[tuple[str, str]],
    root: str,
    fmt: str = "csv",
    options: Mapping[str, str] | None = None,
    source_name: str | None = None,
    force: bool = False,
) -> Version:
    """Build a new version of the dataset below ``root`` and commit all its outputs at once.

    Nothing is built while the landing files, format and options are those of
    the current version, unless ``force``.  The commit's notes hold the report.
    The split index of the landing files is kept below ``root`` for later builds.
    """
    items = _items(sources)
    digest = json.dumps([input_digest(spark, [p for _, p in items]), [n for n, _ in items], fmt, sorted((options or {}).items())])
    found = current(spark, root)
    if found is not None and found.digest == digest and not force:
        return found
    name = os.path.basename(root.rstrip("/"))

    def build(folder: str) -> dict:
        paths = _version_paths(folder)
        return _write_outputs(spark, items, paths, fmt, options, source_name, name, f"{root.rstrip('/')}/splits").first().asDict()

    return publish(spark, root, build, digest)


def published_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """The paths of the current version's outputs."""
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    return _version_paths(found.folder)


def _version_paths(folder: str) -> dict[str, str]:
    return output_paths(f"{folder}/{TABLE}") | {"manifest": f"{folder}/files.parquet"}


def read_lines(
    spark: SparkSession,
    path: str,
    start: DateLike | None = None,
    end: DateLike | None = None,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """The curated lines at ``path``: a Parquet table, or the root of published versions.

    Of published lines only the files that can hold a line of the date range and
    countries are opened; the caller still applies the filter.
    """
    if not path_exists(spark, f"{path.rstrip('/')}/commits"):
        return spark.read.parquet(path)
    paths = published_paths(spark, path)
    if start is None and not countries:
        return spark.read.parquet(paths["curated"])
    return read_needed(spark, paths["curated"], spark.read.parquet(paths["manifest"]), start, end, countries)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The file manifest of the current version."""
    return spark.read.parquet(published_paths(spark, root)["manifest"])


def parse_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Build the curated retail dataset.")
    parser.add_argument(
        "--input",
        action="append",
        required=True,
        metavar="PERIOD=PATH",
        help="landing files of one source period (repeat, in source order)",
    )
    parser.add_argument("--output", required=True)
    parser.add_argument("--format", default="csv", choices=["csv", "json"])
    parser.add_argument(
        "--versioned", action="store_true", help="publish a new version below --output; readers keep the one before until it is whole"
    )
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse_arguments(argv)
    sources = [tuple(item.split("=", 1)) for item in args.input]
    spark = get_session()
    if args.versioned:
        report = publish_dataset(spark, sources, args.output, fmt=args.format).notes
    else:
        report = build_dataset(spark, sources, args.output, fmt=args.format).first().asDict()
    print(json.dumps(report, default=str, indent=2))


if __name__ == "__main__":
    main()
