"""Landing files per source period → one DataFrame of text cells (S1–S3, S1b).

A *source period* (a worksheet in the original workbook) is one file or
folder of CSV files with a header row, or of JSON-lines records.  Every
cell is read as text (no schema inference): validation and typing belong to
``operators.ingest.normalise``, which needs the original text for its error
messages.

``source_row`` is the physical row number inside the period, counting the
header as row 1, exactly as a sheet is numbered.  It is computed without a
global sort: each input split (file, block start) is read sequentially by
one task, so ``monotonically_increasing_id()`` grows by one per row inside a
split; the split index (one row per split: file, block start, rows, header)
gives each split's offset.  Files of a period are taken in path order.  Rows never pass through one task or the driver.
"""

from __future__ import annotations

import csv
import hashlib
import json
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import KIND_PREFIX, ORDINAL, RAW_HEADERS, check_headers
from ..plans.datasets import ensure_dataset
from ..session import scratch_path

IDENTIFIER_HEADERS = ("Invoice", "StockCode")
FIRST_DATA_ROW = 2  # row 1 holds the header
BROADCAST_SPLITS = 100_000  # an index of up to so many rows is broadcast, some 20 MB


def _items(sources: Mapping[str, str] | Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return list(sources.items()) if isinstance(sources, Mapping) else list(sources)


def _header_names(text: str, options: Mapping[str, str]) -> list[str]:
    """Column names of one header line."""
    sep, quote = options.get("sep", options.get("delimiter", ",")), options.get("quote", '"')
    return next(csv.reader([text.lstrip("\ufeff")], delimiter=sep, quotechar=quote), [])


def _record(options: Mapping[str, str]) -> Column:
    """The cells of a CSV line as a struct, by the full grammar."""
    fields = ", ".join(f"c{i} string" for i in range(len(RAW_HEADERS)))
    return F.from_csv("value", fields, dict(options))


_EMPTY = '""'
# a cell for each header, empty ones in quotes, no other quotes
_EMPTY_QUOTED = r'^(?:""|[^",]*)(?:,(?:""|[^",]*)){%d}\z' % (len(RAW_HEADERS) - 1)


def _plain_cells() -> Column:
    """The parts of a line without quotes but those of empty cells, one more than there are headers at most; else NULL."""
    plain = ~F.contains("value", F.lit('"')) | F.col("value").rlike(_EMPTY_QUOTED)
    return F.when(plain, F.split("value", ",", len(RAW_HEADERS) + 1))


def _plain_record(record: Column) -> Column:
    """``record`` by the default options, read from the parts of ``_ln_cells`` where that has a cell for each header.

    The grammar prepares its parser anew for each line, which takes several times
    as long as the rest of its work.
    """
    parts = [F.get("_ln_cells", F.lit(i)) for i in range(len(RAW_HEADERS))]
    cells = [F.when(~c.isin("", _EMPTY), c).alias(f"c{i}") for i, c in enumerate(parts)]
    return F.when(F.size("_ln_cells") == len(RAW_HEADERS), F.struct(*cells)).otherwise(record)


def csv_cells(
    tagged: DataFrame,
    period: str,
    options: Mapping[str, str],
    per_file: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """Numbered text cells of CSV lines that carry the tags of ``tag_rows``.

    The first line of each file is its header.  Every header must hold exactly
    the expected names; each file's cells are bound by its own header, so files
    of one period may order their columns differently.  A blank line is a row
    without values, as in a sheet.  Each line is parsed once, by position,
    whatever the number of column orders.  ``index`` is the split index of these
    lines, if there is one already.
    """
    splits = split_index(tagged, per_file, headers=True) if index is None else index
    found = splits.where("_ln_b = 0").groupBy("_ln_header").agg(F.min("_ln_f").alias("file")).collect()
    if not found:
        check_headers([], period)
    orders = {r["_ln_header"]: _header_names(r["_ln_header"], options) for r in found}
    for r in found:
        names = orders[r["_ln_header"]]
        check_headers(names if len(names) == len(set(names)) else [*names, "repeated name"], period, r["file"])
    numbered = _numbered(tagged, splits, FIRST_DATA_ROW, "source_row", index is not None)
    # columns of their own, used several times: the optimiser keeps them in one place
    if options:
        parsed = numbered.withColumn("_ln_record", _record(options))
    else:
        parsed = numbered.withColumn("_ln_cells", _plain_cells()).withColumn("_ln_record", _plain_record(_record(options)))
    order = next(iter(orders.values())) if len(orders) == 1 else RAW_HEADERS

    def cell(header: str):
        places = {h: F.col(f"_ln_record.c{names.index(header)}") for h, names in orders.items()}
        if len(places) == 1:
            return next(iter(places.values()))
        return F.coalesce(*[F.when(F.col("_ln_header") == F.lit(h), c) for h, c in places.items()])

    return parsed.select("_ln_file", "source_row", *[cell(h).alias(h) for h in order])


def _kind(cell) -> "F.Column":
    """Python type of a JSON cell: int, float, bool, text (NULL when absent)."""
    t = F.schema_of_variant(cell)
    return (
        F.when(F.is_variant_null(cell) | cell.isNull(), F.lit(None).cast("string"))
        .when(t == "BOOLEAN", F.lit("bool"))
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit("float"))
        .otherwise(F.lit("text"))
    )


def _read_json_period(spark: SparkSession, path: str, period: str, index_dir: str) -> DataFrame:
    """JSON lines → numbered text cells plus ``_kind_<header>`` per cell.

    Each line is parsed into a VARIANT so a cell keeps its JSON type: the
    validation treats booleans as non-numbers and writes numbers unquoted in
    its messages, as for typed workbook cells.  A line that is not JSON
    gives an all-missing row (quarantined like an empty sheet row).
    """
    tagged = tag_rows(spark.read.text(path))
    index = stored_split_index(spark, tagged, path, index_dir, headers=False)
    lines = number_tagged(tagged, index=index).drop("_ln_file")
    first = lines.where(F.trim("value") != "").orderBy("source_row").limit(1)
    keys = first.select(F.json_object_keys("value").alias("k")).first()
    check_headers(list(keys["k"] or []) if keys else [], period)
    record = F.try_parse_json("value")
    cells, kinds = [], []
    for h in RAW_HEADERS:
        cell = F.try_variant_get(record, f"$['{h}']", "variant")
        kind = _kind(cell)
        text = F.when(kind == "bool", F.when(F.try_variant_get(cell, "$", "boolean"), "True").otherwise("False"))
        if h in IDENTIFIER_HEADERS:
            number = F.try_variant_get(cell, "$", "double")
            whole = (kind == "float") & (F.abs(number) < 1e38) & (number == F.floor(number).cast("double"))
            text = text.when(whole, number.try_cast("decimal(38,0)").cast("string"))
        cells.append(text.otherwise(F.try_variant_get(cell, "$", "string")).alias(h))
        kinds.append(kind.alias(f"{KIND_PREFIX}{h}"))
    return lines.select("source_row", *cells, *kinds)


def tag_splits(df: DataFrame) -> DataFrame:
    """Add the split key (file path, block start); directly on a file scan.

    Allowed on a streaming file source as well.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_ln_file"),
        F.col("_metadata.file_block_start").alias("_ln_block"),
    )


def tag_sequence(df: DataFrame) -> DataFrame:
    """Add the in-split sequence id (rows of a split are read in file order)."""
    return df.withColumn("_ln_id", F.monotonically_increasing_id())


def tag_rows(df: DataFrame) -> DataFrame:
    """Split key and in-split sequence id of a (batch) file scan."""
    return tag_sequence(tag_splits(df))


def split_index(tagged: DataFrame, per_file: bool = False, headers: bool = False) -> DataFrame:
    """One row per input split: its first tag, its rows, and the data rows before it.

    With ``headers`` each file's first line counts as no row and comes along.
    The lines are scanned once.  The rows before a split are summed up over this
    small table, one row a split, which one task holds unless numbers restart ``per_file``.
    """
    in_head = F.col("_ln_block") == 0
    line = F.min_by(F.when(in_head, F.col("value")), "_ln_id") if headers else F.lit(None).cast("string")
    # beside an aggregate of objects (an empty set) Spark keeps the groups, one a split,
    # in a hash table; the least of a text alone would have every line sorted by its split
    nothing = F.collect_set(F.lit(None).cast("int"))
    splits = tagged.groupBy("_ln_file", "_ln_block").agg(
        F.min("_ln_id").alias("_ln_first"),
        F.count(F.lit(1)).alias("_ln_rows"),
        (F.when(F.size(nothing) == 0, line) if headers else line).alias("_ln_line"),
    )
    head = F.when(in_head, 1).otherwise(0) if headers else F.lit(0)
    own = Window.partitionBy("_ln_file")
    ordered = own.orderBy("_ln_block") if per_file else Window.orderBy("_ln_file", "_ln_block")
    rows = F.col("_ln_rows") - F.col("_ln_head")
    return splits.withColumn("_ln_head", head).select(
        F.col("_ln_file").alias("_ln_f"),
        F.col("_ln_block").alias("_ln_b"),
        "_ln_first",
        "_ln_rows",
        "_ln_head",
        F.max("_ln_line").over(own).alias("_ln_header"),
        F.coalesce(F.sum(rows).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ln_before"),
    )


# how a scan is cut into splits and dealt to tasks depends on these settings
_SCAN_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


def stored_split_index(spark: SparkSession, tagged: DataFrame, path: str, folder: str, headers: bool) -> DataFrame:
    """The split index of the files at ``path``, computed once and kept below ``folder``.

    It is computed again when a file is new, changed or gone, or when the scan is
    cut differently.
    """
    settings = [spark.conf.get(s, None) for s in _SCAN_SETTINGS]
    name = hashlib.sha256(json.dumps([path, headers, *settings, spark.sparkContext.defaultParallelism]).encode()).hexdigest()[:16]
    return ensure_dataset(spark, f"{folder.rstrip('/')}/{name}", lambda: split_index(tagged, headers=headers), inputs=[path])


def _numbered(tagged: DataFrame, splits: DataFrame, start: int, name: str, stored: bool) -> DataFrame:
    """Row numbers from the splits' offsets; header lines are left out.

    A row whose split is not in ``splits``, or has another place in it, fails the
    load (the two scans were cut differently): no row is lost or misnumbered in
    silence.
    """
    if stored and splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    joined = tagged.join(
        splits, (F.col("_ln_file") == F.col("_ln_f")) & (F.col("_ln_block") == F.col("_ln_b")), "left"
    )
    at = F.col("_ln_id") - F.col("_ln_first")
    place = at - F.col("_ln_head")
    row = F.col("_ln_before") + place + F.lit(start)
    known = F.col("_ln_f").isNotNull() & (at >= 0) & (at < F.col("_ln_rows"))
    matched = F.when(known, row).otherwise(
        F.raise_error(F.lit("landing split was cut differently on its second scan"))
    )
    keep = [c for c in tagged.columns if c not in ("_ln_block", "_ln_id")]
    in_header = F.coalesce(known & (place < 0), F.lit(False))
    return joined.where(~in_header).select(*keep, "_ln_header", matched.cast("bigint").alias(name))


def number_tagged(
    tagged: DataFrame,
    start: int = FIRST_DATA_ROW,
    name: str = "source_row",
    per_file: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """Physical row numbers from the tags of ``tag_rows``.

    Splits are ordered by (file path, block start); numbering runs across
    all files (files of one period continue one another, like the rows of
    one sheet) or restarts per file with ``per_file``.  Keeps ``_ln_file``.
    """
    splits = split_index(tagged, per_file) if index is None else index
    return _numbered(tagged, splits, start, name, index is not None).drop("_ln_header")


def number_rows(df: DataFrame, start: int = FIRST_DATA_ROW, name: str = "source_row") -> DataFrame:
    """Append the physical row number of each row within its period's files.

    Requires a plain file scan underneath.
    """
    return number_tagged(tag_rows(df), start=start, name=name).drop("_ln_file")


def read_landing(
    spark: SparkSession,
    sources: Mapping[str, str] | Iterable[tuple[str, str]],
    fmt: str = "csv",
    options: Mapping[str, str] | None = None,
    index_dir: str | None = None,
) -> DataFrame:
    """Read every period, check its header, number its rows, stack them.

    Numbering needs the rows of each input split, from a scan of the lines.  This
    split index is kept below ``index_dir`` (else in the shared folder), so that
    later reads of the same files do not scan them for it again.

    Output: ``source_ordinal, source_period, source_row`` and the eight
    text cells named as in the landing header.  A period whose header is
    not exactly the expected set of names fails the whole load.
    """
    frames = []
    index_dir = index_dir or scratch_path(spark, "splits")
    for ordinal, (period, path) in enumerate(_items(sources)):
        if fmt == "json":
            numbered = _read_json_period(spark, path, period, index_dir)
            kinds = [F.col(f"`{KIND_PREFIX}{h}`") for h in RAW_HEADERS]
        else:
            if fmt != "csv":
                raise ValueError(f"unsupported landing format: {fmt!r}")
            # directly on the file scan (``_metadata``)
            tagged = tag_rows(spark.read.text(path))
            index = stored_split_index(spark, tagged, path, index_dir, headers=True)
            numbered = csv_cells(tagged, period, options or {}, index=index)
            kinds = []
        frames.append(
            numbered.select(
                F.lit(ordinal).alias(ORDINAL),
                F.lit(period).alias("source_period"),
                "source_row",
                *[F.col(f"`{h}`").cast("string").alias(h) for h in numbered.columns if h in RAW_HEADERS],
                *kinds,
            )
        )
    if not frames:
        raise ValueError("no landing sources given")
    return reduce(lambda a, b: a.unionByName(b), frames)
