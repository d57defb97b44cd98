"""The curated fact-table schema and its computed columns (P2–P4).

The curated table is one denormalised row per transaction line:

    transaction_line_id  bigint         dense, source order, staged rows only
    source_period        string         landing period (worksheet title)
    invoice_no           string         'C…' marks a cancellation
    stock_code           string
    description          string
    quantity             int
    invoice_timestamp    timestamp_ntz
    unit_price           double
    customer_id          bigint         NULL = unknown customer
    country              string
    is_cancelled         boolean        NULL when invoice_no is NULL
    line_revenue         double         quantity * unit_price, two decimals
    is_valid_sale        boolean        not cancelled, quantity > 0, price > 0
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import round_half_away

STAGED_COLUMNS = [
    ("source_period", T.StringType()),
    ("invoice_no", T.StringType()),
    ("stock_code", T.StringType()),
    ("description", T.StringType()),
    ("quantity", T.IntegerType()),
    ("invoice_timestamp", T.TimestampNTZType()),
    ("unit_price", T.DoubleType()),
    ("customer_id", T.LongType()),
    ("country", T.StringType()),
]

FLAG_COLUMNS = [
    ("is_cancelled", T.BooleanType()),
    ("line_revenue", T.DoubleType()),
    ("is_valid_sale", T.BooleanType()),
]

CURATED_SCHEMA = T.StructType(
    [T.StructField("transaction_line_id", T.LongType(), False)]
    + [T.StructField(name, dtype, True) for name, dtype in STAGED_COLUMNS + FLAG_COLUMNS]
)


def is_cancelled(invoice: str = "invoice_no") -> Column:
    """``starts_with(upper(invoice_no), 'C')``; lower-case 'c…' counts too."""
    return F.startswith(F.upper(F.col(invoice)), F.lit("C"))


def line_revenue(quantity: str = "quantity", price: str = "unit_price") -> Column:
    return round_half_away(F.col(quantity) * F.col(price), 2)


def is_valid_sale(
    invoice: str = "invoice_no", quantity: str = "quantity", price: str = "unit_price"
) -> Column:
    """Three-valued like SQL: a blank invoice with positive quantity and price is NULL."""
    return (~is_cancelled(invoice)) & (F.col(quantity) > 0) & (F.col(price) > 0)


def with_sale_flags(staged: DataFrame) -> DataFrame:
    """Append ``is_cancelled``, ``line_revenue`` and ``is_valid_sale``."""
    return staged.withColumns(
        {
            "is_cancelled": is_cancelled(),
            "line_revenue": line_revenue(),
            "is_valid_sale": is_valid_sale(),
        }
    )
