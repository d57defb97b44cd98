"""Landing rows → validated staging rows + quarantine → curated lines.

``normalise`` is a stateless ``DataFrame → DataFrame`` projection; a stream
runs it on each micro-batch (its run counters need a batch DataFrame).  Every rule is a Column
expression from ``functions.normalise`` and the first failing rule, in the
order Quantity → Price → InvoiceDate → Customer ID, names the error.  The
staged and quarantined outputs are two filters of the same projection.

``curate`` adds the dense ``transaction_line_id`` in source order and the
three sale flags.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.curation import CURATED_SCHEMA, with_sale_flags
from ..functions.numeric import cents
from .ranking import row_number_by_position

# fixed values: landing header → curated column names
HEADER_MAP = {
    "Invoice": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_timestamp",
    "Price": "unit_price",
    "Customer ID": "customer_id",
    "Country": "country",
}
RAW_HEADERS = list(HEADER_MAP)
NUMBER_HEADERS = ["Quantity", "Price", "Customer ID"]
ORDINAL = "source_ordinal"  # optional: position of the period among the inputs
RAW_PREFIX = "_raw_"  # original landing cells kept beside the typed values
KIND_PREFIX = "_kind_"  # optional per-cell JSON type: int, float, bool, text


class Normalised(NamedTuple):
    checked: DataFrame  # every row, typed values + ``error``
    staged: DataFrame  # rows without error, staging columns
    quarantine: DataFrame  # source_period, source_row, error, raw_values (row repr)
    counters: Observation  # source_rows, staged_rows, quarantined_rows


def _cell(name: str):
    return F.col(f"`{name}`")


def check_headers(columns: list[str], period: str, file: str | None = None) -> None:
    """The landing header must hold exactly the expected names (any order)."""
    found = [
        c
        for c in columns
        if c not in ("source_period", "source_row", ORDINAL) and not c.startswith(KIND_PREFIX)
    ]
    if set(found) != set(RAW_HEADERS):
        where = f" in {file}" if file else ""
        raise ValueError(f"Unexpected columns in sheet '{period}': {tuple(found)}{where}")


CHECKED_CELLS = ["Quantity", "Price", "InvoiceDate", "Customer ID"]
TEXT_HEADERS = [h for h in RAW_HEADERS if h not in CHECKED_CELLS]
VALUES = list(HEADER_MAP.values())


def _text(header: str):
    return F.nullif(N.strip_text(_cell(header)), F.lit(""))


def _common_row() -> dict:
    """The values of a row in common form, by curated column name."""
    typed = N.common_values(*[_cell(h) for h in CHECKED_CELLS])
    return {HEADER_MAP[h]: _text(h) for h in TEXT_HEADERS} | typed


def _is_common():
    return N.in_common_form(*[_cell(h) for h in CHECKED_CELLS])


def _layout(raw: DataFrame) -> tuple[list[str], list[str], bool]:
    """Key columns, the cells in file order, and whether cells have types."""
    check_headers(raw.columns, "<input>")
    keys = [c for c in (ORDINAL,) if c in raw.columns] + ["source_period", "source_row"]
    return keys, [c for c in raw.columns if c in HEADER_MAP], all(f"{KIND_PREFIX}{h}" in raw.columns for h in RAW_HEADERS)


def _nothing(name: str):
    return F.lit(None).cast("string").alias(name)


def common_lane(raw: DataFrame) -> DataFrame:
    """The rows in common form: a short projection of casts, compiled as a whole.

    Such a row has no error, so its original cells are not kept.
    """
    keys, cells, _ = _layout(raw)
    values = _common_row()
    carried = [f"{p}{h}" for p in (RAW_PREFIX, KIND_PREFIX) for h in cells]
    return raw.where(_is_common()).select(
        *keys, *[values[v].alias(v) for v in VALUES], _nothing("error"), *[_nothing(c) for c in carried]
    )


def first_pass(raw: DataFrame) -> DataFrame:
    """Every row once: values of the rows in common form, original cells of the others.

    ``_common`` tells them apart.  Written, it lets both lanes be read without a
    second parse of the landing files; see ``second_pass``.
    """
    keys, cells, typed = _layout(raw)
    values = _common_row()
    common = F.col("_common")
    kinds = [F.col(f"`{KIND_PREFIX}{h}`") for h in cells] if typed else []  # else all are texts
    return raw.withColumn("_common", _is_common()).select(
        *keys,
        "_common",
        *[F.when(common, values[v]).alias(v) for v in VALUES],
        *[F.when(~common, _cell(h)).alias(f"{RAW_PREFIX}{h}") for h in cells],
        *[F.when(~common, k).alias(f"{KIND_PREFIX}{h}") for h, k in zip(cells, kinds)],
    )


def second_pass(first: DataFrame) -> DataFrame:
    """The checked rows of ``first_pass`` that are not in common form."""
    keys = [c for c in (ORDINAL, "source_period", "source_row") if c in first.columns]
    cells = [c[len(RAW_PREFIX):] for c in first.columns if c.startswith(RAW_PREFIX)]
    raw = first.where("not _common").select(
        *keys,
        *[F.col(f"`{RAW_PREFIX}{h}`").alias(h) for h in cells],
        *[F.col(f"`{c}`") for c in first.columns if c.startswith(KIND_PREFIX)],
    )
    return full_lane(raw, only_uncommon=False)


def common_part(first: DataFrame) -> DataFrame:
    """The checked rows of ``first_pass`` in common form."""
    cells = [c[len(RAW_PREFIX):] for c in first.columns if c.startswith(RAW_PREFIX)]
    carried = [f"{p}{h}" for p in (RAW_PREFIX, KIND_PREFIX) for h in cells]
    keys = [c for c in (ORDINAL, "source_period", "source_row") if c in first.columns]
    return first.where("_common").select(*keys, *VALUES, _nothing("error"), *[_nothing(c) for c in carried])


def normalise(raw: DataFrame) -> Normalised:
    """Validate and type landing rows.

    ``raw`` has ``source_period``, ``source_row`` (optional
    ``source_ordinal``) and the eight text cells named as in ``HEADER_MAP``.

    All rows take the full rules, in one scan: as a union of two lazy lanes the
    same rows took longer (two scans).  The build job, which writes the checked
    rows anyway, runs the full rules on uncommon rows only: see ``first_pass``.
    """
    checked = full_lane(raw, only_uncommon=False)
    # Run counters ride along with the first action over ``checked``.  The
    # observation node is also where Catalyst stops pushing the staged /
    # quarantine filters down: without it ``error IS NULL`` would be inlined
    # below the projections as a second copy of the whole validation.
    counters = Observation(f"ingest_{uuid.uuid4().hex[:12]}")
    ok = F.col("error").isNull()
    checked = checked.observe(
        counters,
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(ok).alias("staged_rows"),
        F.count_if(~ok).alias("quarantined_rows"),
    )
    staged, quarantine = split_checked(checked)
    return Normalised(checked, staged, quarantine, counters)


def full_lane(raw: DataFrame, only_uncommon: bool = True) -> DataFrame:
    """Checked rows by the full rules, of all rows or of those not in common form."""
    keys, cell_order, typed = _layout(raw)
    if only_uncommon:
        raw = raw.where(~_is_common())

    def kind(header: str):
        return F.col(f"`{KIND_PREFIX}{header}`") if typed else F.lit("text")
    idx = {h: i for i, h in enumerate(RAW_HEADERS)}

    def stripped(header: str):
        return F.col(f"_s{idx[header]}")

    # (A) stripped cells and the ISO groups of the date
    prepared = raw.select(
        *keys,
        *[_cell(h).alias(h) for h in RAW_HEADERS],
        *[N.strip_text(_cell(h)).alias(f"_s{idx[h]}") for h in RAW_HEADERS],
        *[N.strip_number_text(_cell(h)).alias(f"_n{idx[h]}") for h in NUMBER_HEADERS],
        *[kind(h).alias(f"{KIND_PREFIX}{h}") for h in RAW_HEADERS],
        N.is_common_timestamp(N.strip_text(_cell("InvoiceDate"))).alias("_tcommon"),
    ).withColumn("_iso", N.iso_parts(stripped("InvoiceDate"), F.col("_tcommon")))

    def number_text(header: str):
        return F.col(f"_n{idx[header]}")

    # (B) parsed numbers and date parts
    parsed = prepared.withColumns(
        {
            **N.number_fields(number_text("Quantity"), "_q"),
            **N.number_fields(number_text("Price"), "_p"),
            **N.number_fields(number_text("Customer ID"), "_c"),
            **N.timestamp_fields(stripped("InvoiceDate"), F.col("_iso"), "_t", F.col("_tcommon")),
        }
    )
    # (C) values and the first error in the order Quantity, Price, date, customer
    def kind_col(header: str):
        return F.col(f"`{KIND_PREFIX}{header}`")

    quantity, quantity_err = N.number_result(
        _cell("Quantity"), "Quantity", "_q", bits=32, kind=kind_col("Quantity")
    )
    price, price_err = N.number_result(_cell("Price"), "Price", "_p", kind=kind_col("Price"))
    ts, ts_err = N.timestamp_result("_t")
    customer_raw = _cell("Customer ID")
    blank_customer = customer_raw.isNull() | (stripped("Customer ID") == F.lit(""))
    customer, customer_err = N.number_result(
        customer_raw, "Customer ID", "_c", bits=64, kind=kind_col("Customer ID")
    )

    def text(header: str):
        return F.nullif(stripped(header), F.lit(""))

    return parsed.select(
        *keys,
        text("Invoice").alias("invoice_no"),
        text("StockCode").alias("stock_code"),
        text("Description").alias("description"),
        quantity.alias("quantity"),
        ts.alias("invoice_timestamp"),
        price.alias("unit_price"),
        F.when(~blank_customer, customer).alias("customer_id"),
        text("Country").alias("country"),
        F.coalesce(
            quantity_err, price_err, ts_err, F.when(~blank_customer, customer_err)
        ).alias("error"),
        # original cells ride along; ``raw_values`` is built for quarantined
        # rows only (the observation node below keeps every column alive)
        *[_cell(h).alias(f"{RAW_PREFIX}{h}") for h in cell_order],
        *[kind_col(h).alias(f"{KIND_PREFIX}{h}") for h in cell_order],
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged rows (no error) and quarantine rows of a checked DataFrame."""
    cells = [c[len(RAW_PREFIX):] for c in checked.columns if c.startswith(RAW_PREFIX)]  # file order
    carried = [f"{RAW_PREFIX}{h}" for h in cells] + [f"{KIND_PREFIX}{h}" for h in cells]
    staged = checked.where(F.col("error").isNull()).drop("error", *carried)
    # Python's repr of the row tuple, e.g. ('536381', 'TEST', ..., None), each
    # cell rendered by its type; evaluated for quarantined rows only
    shown = [
        N.typed_repr(F.col(f"`{RAW_PREFIX}{h}`"), F.col(f"`{KIND_PREFIX}{h}`")) for h in cells
    ]
    raw_values = F.concat(F.lit("("), F.concat_ws(", ", *shown), F.lit(")"))
    quarantine = checked.where(F.col("error").isNotNull()).select(
        "source_period",
        F.col("source_row").cast("bigint").alias("source_row"),
        "error",
        raw_values.alias("raw_values"),
    )
    return staged, quarantine


def curate(staged: DataFrame, folder: str | None = None, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Typed, flagged curated lines with a dense id in source order (P1–P4).

    Source order is (period ordinal if present, else period name; source
    row).  ``source_row`` is unique within a period, so the id comes from a
    small table of the source rows that occur (``row_number_by_position``) —
    never a global single-partition window, and the lines are not sorted.  That
    table is written below ``folder``, if one is given.  ``deal`` deals the rows out
    for the caller's sort, before the id and the flags are added if it can; a column
    that it adds comes last.
    """
    group = ORDINAL if ORDINAL in staged.columns else "source_period"
    numbered = row_number_by_position(staged, group, "source_row", name="transaction_line_id", folder=folder, deal=deal)
    flagged = with_sale_flags(numbered)
    added = [c for c in numbered.columns if c not in (*staged.columns, "transaction_line_id")]
    return flagged.select(*[f.name for f in CURATED_SCHEMA.fields], *added)


def error_counts(quarantine: DataFrame) -> DataFrame:
    """Quarantined rows per error kind (message without the ``got …`` part)."""
    return quarantine.groupBy(
        F.regexp_replace("error", ", got .*$", "").alias("error_kind")
    ).agg(F.count(F.lit(1)).alias("rows"))


def ingest_report(raw: DataFrame) -> DataFrame:
    """One-row build report in one pass over the landing rows.

    Run counters (source/staged/quarantined rows) plus the nine quality
    measures of the curated table, computed from the same projection.
    """
    checked = with_sale_flags(normalise(raw).checked)  # raw cells pruned by the aggregate
    ok = F.col("error").isNull()
    return checked.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(ok).alias("staged_rows"),
        F.count_if(~ok).alias("quarantined_rows"),
        F.count_if(ok).alias("raw_rows"),
        F.count_if(ok & F.col("is_valid_sale")).alias("valid_sale_rows"),
        F.count_if(ok & F.col("is_cancelled")).alias("cancelled_rows"),
        F.count_if(ok & F.col("customer_id").isNull()).alias("missing_customer_rows"),
        F.count_if(ok & (F.col("quantity") <= 0)).alias("non_positive_quantity_rows"),
        F.count_if(ok & (F.col("unit_price") <= 0)).alias("non_positive_price_rows"),
        F.min(F.when(ok, F.col("invoice_timestamp"))).alias("first_transaction"),
        F.max(F.when(ok, F.col("invoice_timestamp"))).alias("last_transaction"),
        (
            F.sum(F.when(ok & F.col("is_valid_sale"), cents("line_revenue"))).cast("double")
            / F.lit(100.0)
        ).alias("valid_revenue"),
    )
