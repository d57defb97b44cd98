"""The Spark normaliser against Python itself.

Python's ``float()``, ``int`` checks and ``datetime.fromisoformat`` are the
behaviour the ingest rules reproduce; each case runs through the Spark
expressions and through a few lines of plain Python, and the values and
messages must agree.
"""

from __future__ import annotations

import math
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators.ingest import RAW_HEADERS, normalise

GOOD = {
    "Invoice": "536365",
    "StockCode": "85123A",
    "Description": "X",
    "Quantity": "1",
    "InvoiceDate": "2010-12-01 08:26:00",
    "Price": "1.5",
    "Customer ID": "17850",
    "Country": "UK",
}


def py_number(v, field, integral=False, bits=None):
    try:
        x = float(v) if v is not None else None
        if x is None:
            raise TypeError
    except (TypeError, ValueError):
        return None, f"{field} must be numeric, got {v!r}"
    if not math.isfinite(x):
        return None, f"{field} must be finite, got {v!r}"
    if integral:
        if not x.is_integer():
            return None, f"{field} must be an integer, got {v!r}"
        if bits and not (-(2.0 ** (bits - 1)) <= x < 2.0 ** (bits - 1)):
            return None, f"{field} must fit in {bits} bits, got {v!r}"
        return int(x), None
    return x, None


def py_timestamp(v):
    text = str(v).strip()
    try:
        ts = datetime.fromisoformat(text)
    except ValueError as e:
        return None, str(e)
    return ts.replace(tzinfo=None, microsecond=0), None


def run(spark, column, values):
    rows = []
    for i, v in enumerate(values):
        rec = dict(GOOD)
        rec[column] = v
        rows.append(("P", i + 2, *[rec[h] for h in RAW_HEADERS]))
    df = spark.createDataFrame(rows, ["source_period", "source_row", *RAW_HEADERS])
    out = normalise(df).checked.orderBy("source_row").collect()
    return out


NUMBER_CASES = [
    "1", " 7 ", "-3", "+4", "1.5", "6.0", ".5", "5.", ".", "1e5", "1E+5", "1e", "1_000", "1__0", "_1",
    "1_", "1d", "0x10", "inf", "-Infinity", "nan", "+NaN", "infinity ", "", "None", "True", "1e400",
    "-0.0", "1,5", "bad quantity", "9" * 30, "2147483648", "-2147483648", "2147483647", "\t12\n",
    " 12 ", "\x1c5\x1f", "it's", 'say "hi"', "a'b\"c", "back\\slash", None,
    "\u0661\u0662", "\u0661.\u0665", "\u0663_\u0660", "\U0001d7d9\U0001d7da", "\u0966e\u0967",
]


def test_quantity_matches_python(spark):
    out = run(spark, "Quantity", NUMBER_CASES)
    for v, row in zip(NUMBER_CASES, out):
        value, err = py_number(v, "Quantity", integral=True, bits=32)
        assert row["error"] == err, v
        if err is None:
            assert row["quantity"] == value, v


def test_price_matches_python(spark):
    out = run(spark, "Price", NUMBER_CASES)
    for v, row in zip(NUMBER_CASES, out):
        value, err = py_number(v, "Price")
        assert row["error"] == err, v
        if err is None:
            assert row["unit_price"] == value, v


def test_customer_id_matches_python(spark):
    cases = NUMBER_CASES + ["17850.0", "  ", "12345678901234567890"]
    out = run(spark, "Customer ID", cases)
    for v, row in zip(cases, out):
        if v is None or str(v).strip() == "":
            assert row["error"] is None and row["customer_id"] is None, v
            continue
        value, err = py_number(v, "Customer ID", integral=True, bits=64)
        assert row["error"] == err, v
        if err is None:
            assert row["customer_id"] == value, v


TIMESTAMP_CASES = [
    "2010-12-01 08:26:00", "2010-12-01", "20101201", "2010-12", "2010", "2010-W48-3", "2010W483",
    "2010-W48", "2010W48", "2010-12-01T24:00", "2010-13-01", "2010-02-30", "2012-02-29", "0000-01-01",
    "2010-12-01 25:00", "2010-12-01 08:60", "2010-12-01 08:26:60", "2010-12-01x08:26", "2010-12-01T",
    "2010-12-01 08", "2010-12-01 0826", "2010-12-01 082600.5", "2010-12-01 08:26:00,123456789",
    "2010-12-01 08:26:00+01:00", "2010-12-01 08:26:00Z", "2010-12-01 08:26:00+0100", "2010-W53-1",
    "2015-W53-1", "2010-W00-1", "2010-W10-8", "2010-335", "20101201T0826", "2010-12-01 8:26",
    "2010-12-01 08:26:00.", "2010-12-01 08:2", "201012-01", " 2010-12-01 ", "not a date", "", None,
    "2010-12-01T08:26:00.999999", "2009-12-31T23:59:59", "0000-01-01 00:00:00", "0000-W01-1",
    "00000101", "9999-W52-7", "9999-12-31T23:59:59", "0001-W01-1", "2010-01-01T08,5",
    "20100101T0830.5", "2010-12-01T08:26+24:00", "2010-12-01T08:26-24:00", "2010-12-01T08:26+25",
    "2010-12-01T08:26-25:30", "2010-12-01T08:26+01:75", "2010-12-01T08:26+23:59:59",
    "2010-12-01T08:26+99", "2010-12-01T08:26-00:00:00.5", "2010-13-01T08:26+25:00",
    "2010-12-01T08:26+24:00:00.5", "2010-12-01T08:26-24:00:00,25",
]


def test_invoice_date_matches_python(spark):
    out = run(spark, "InvoiceDate", TIMESTAMP_CASES)
    for v, row in zip(TIMESTAMP_CASES, out):
        value, err = py_timestamp(v)
        assert row["error"] == err, v
        if err is None:
            assert row["invoice_timestamp"] == value, v


@settings(max_examples=15, deadline=None)
@given(st.lists(st.from_regex(r"\A[ +\-_.eE0-9naifINF]{0,8}\Z"), min_size=1, max_size=25))
def test_random_number_texts_match_python(spark, values):
    out = run(spark, "Price", values)
    for v, row in zip(values, out):
        value, err = py_number(v, "Price")
        assert row["error"] == err, repr(v)
        if err is None:
            assert row["unit_price"] == value, repr(v)


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.from_regex(r"\A[0-9]{4}(-?[0-9]{2}-?[0-9]{2}|-?W[0-9]{2}(-?[0-9])?)([ T][0-9:.,+Z-]{0,12})?\Z"),
        min_size=1,
        max_size=25,
    )
)
def test_random_iso_texts_match_python(spark, values):
    out = run(spark, "InvoiceDate", values)
    for v, row in zip(values, out):
        value, err = py_timestamp(v)
        assert row["error"] == err, repr(v)
        if err is None:
            assert row["invoice_timestamp"] == value, repr(v)


def test_text_cells_are_stripped_and_blank_is_null(spark):
    out = run(spark, "Description", ["  padded \t", "", "   ", None, "　wide　"])
    assert [r["description"] for r in out] == ["padded", None, None, None, "wide"]


def test_first_error_wins_in_field_order(spark):
    rec = dict(GOOD, Quantity="x", Price="y", InvoiceDate="z", **{"Customer ID": "w"})
    df = spark.createDataFrame([("P", 2, *[rec[h] for h in RAW_HEADERS])], ["source_period", "source_row", *RAW_HEADERS])
    assert normalise(df).quarantine.first()["error"] == "Quantity must be numeric, got 'x'"
    rec["Quantity"] = "1"
    df = spark.createDataFrame([("P", 2, *[rec[h] for h in RAW_HEADERS])], ["source_period", "source_row", *RAW_HEADERS])
    assert normalise(df).quarantine.first()["error"] == "Price must be numeric, got 'y'"
    rec["Price"] = "1"
    df = spark.createDataFrame([("P", 2, *[rec[h] for h in RAW_HEADERS])], ["source_period", "source_row", *RAW_HEADERS])
    assert normalise(df).quarantine.first()["error"] == "Invalid isoformat string: 'z'"


def test_validation_stays_in_generated_code(spark):
    """The filter above the observed metrics must not re-inline validation."""
    rows = [("P", 2, *[GOOD[h] for h in RAW_HEADERS])]
    df = spark.createDataFrame(rows, ["source_period", "source_row", *RAW_HEADERS])
    plan = normalise(df).staged._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all("regexp" not in line.lower() and "rlike" not in line.lower() for line in filters)


def _random_iso(rng):
    y = rng.choice(["2010", "0000", "2015", "9999", "2012", "0001"])
    sep = rng.choice(["-", ""])
    if rng.random() < 0.2:
        date = y + sep + "W" + f"{rng.randint(0, 54):02d}"
        if rng.random() < 0.6:
            date += sep + str(rng.randint(0, 8))
    else:
        date = y + sep + f"{rng.randint(0, 13):02d}" + sep + f"{rng.randint(0, 32):02d}"
    if rng.random() < 0.3:
        return date
    time, tsep = f"{rng.randint(0, 25):02d}", rng.choice([":", ""])
    for _ in range(rng.randint(0, 2)):
        time += tsep + f"{rng.randint(0, 61):02d}"
    if rng.random() < 0.3:
        time += rng.choice([".", ","]) + "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 8)))
    return date + rng.choice(["T", " ", "x", "T"]) + time


def test_bulk_random_cells_match_python(spark):
    """1,500 seeded random numbers and ISO-like dates in one Spark job."""
    import random

    rng = random.Random(11)
    alphabet = list("0123456789._eE+- ") + ["١", "०", "\xa0", "　", "\x1c", "in", "f", "nan", "'", "\\"]
    numbers = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    dates = [_random_iso(rng) for _ in range(1500)]
    rows = []
    for i, (n, d) in enumerate(zip(numbers, dates)):
        rec = dict(GOOD, Price=n, InvoiceDate=d)
        rows.append(("P", i + 2, *[rec[h] for h in RAW_HEADERS]))
    df = spark.createDataFrame(rows, ["source_period", "source_row", *RAW_HEADERS])
    out = normalise(df).checked.orderBy("source_row").collect()
    for n, d, row in zip(numbers, dates, out):
        pv, pe = py_number(n, "Price")
        tv, te = py_timestamp(d)
        assert row["error"] == (pe or te), (n, d)
        if pe is None and te is None:
            assert (row["unit_price"], row["invoice_timestamp"]) == (pv, tv), (n, d)
