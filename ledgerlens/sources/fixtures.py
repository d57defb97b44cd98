"""Transaction lines derived from the TPC-H-style driver tables.

``retail_lines`` is the curated fact table (FIXTURES F3) built from
``lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation``; ``raw_lines`` is the
same join rendered as all-text landing cells with seeded faults (FIXTURES
F4), so the normaliser and quarantine can be checked against an oracle.

Join plan at scale: no side is hinted — Catalyst/AQE choose sort-merge or broadcast from runtime sizes.
Only the columns each query needs reach the scans (column pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curation import with_sale_flags
from ..operators.ingest import RAW_HEADERS
from ..operators.ranking import SORT_ROWS, row_number_by, sort_partitions
from ..session import scratch_path, shuffle_partitions
from .tables import read_table

# Fixed values of the fixture definition (FIXTURES F3/F4).
CANCEL_FLAG = "R"  # l_returnflag marking a cancellation line
UNSPECIFIED_PRIORITY = "4-NOT SPECIFIED"  # orders without a known customer
BLANK_DESCRIPTION_MOD = 97  # l_partkey % 97 = 0 → no description
BAD_QUANTITY_MOD = 50  # l_partkey % 50: 0 → 'bad quantity', 1 → '1.5'
BAD_DATE_MOD = 25  # l_suppkey % 25 = 1 → 'not a date'
BAD_PRICE_MOD = 20  # l_suppkey % 20: 0 → 'NaN', 1 → 'free'
BAD_CUSTOMER_MOD = 40  # o_custkey % 40 = 0 → 'not-a-customer'
LANDING_TIME = "08:26:00"

# Total order of lineitem rows (all rows distinct under it at every sf).
LINE_ORDER = [
    "o_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]



def _joined(spark: SparkSession, base: str) -> DataFrame:
    """lineitem ⋈ (orders ⋈ customer ⋈ nation) ⋈ part.

    Orders are enriched with the customer's country first, so the fact
    table meets only two joins (order key, part key) and is exchanged at
    most twice; joining customers last would shuffle it a third time by
    customer key.  AQE turns either join into a broadcast when the runtime
    size of the other side allows it.  A large fact table is dealt to more
    partitions than set, so that a task sorts its part of it in memory.
    """
    lineitem = read_table(spark, base, "lineitem")
    parts = sort_partitions(spark, lineitem.count())  # from the files' footers
    if parts > shuffle_partitions(spark):
        lineitem = lineitem.repartition(parts, "l_orderkey")
    orders = read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    part = read_table(spark, base, "part").select("p_partkey", "p_name", "p_retailprice")
    customer = read_table(spark, base, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, base, "nation").select("n_nationkey", "n_name")
    customer_country = customer.join(
        nation, customer.c_nationkey == nation.n_nationkey
    ).select("c_custkey", "n_name")
    orders_country = orders.join(
        customer_country, orders.o_custkey == customer_country.c_custkey
    )
    lines = lineitem.join(orders_country, lineitem.l_orderkey == orders_country.o_orderkey)
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


# what the cells of a line are made of, beside ``LINE_ORDER``
LINE_VALUES = ["o_custkey", "o_orderdate", "o_orderpriority", "p_name", "p_retailprice", "n_name"]


def _numbered(spark: SparkSession, base: str, name: str, by_year: bool, start: int) -> DataFrame:
    """The joined rows with their number, in all or in their order's year.

    Only the columns of the tables are exchanged, sorted and written for it; the
    cells of a line, which are about twice as wide, are derived afterwards.
    """
    joined = _joined(spark, base).select(*LINE_ORDER, *LINE_VALUES)
    keys = []
    if by_year:
        joined, keys = joined.withColumn("_year", F.year("o_orderdate")), ["_year"]
    parts = sort_partitions(spark, read_table(spark, base, "lineitem").count())  # from the files' footers
    return row_number_by(joined, LINE_ORDER, name=name, partition_by=keys, num_partitions=parts, start=start)


def _cancelled() -> Column:
    return F.col("l_returnflag") == F.lit(CANCEL_FLAG)


def _invoice() -> Column:
    return F.concat(
        F.when(_cancelled(), F.lit("C")).otherwise(F.lit("")),
        F.col("o_orderkey").cast("string"),
    )


def _signed_quantity() -> Column:
    q = F.when(_cancelled(), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return q.cast("int")


def _period() -> Column:
    return F.concat(F.lit("Year "), F.year("o_orderdate").cast("string"))


def retail_lines(spark: SparkSession, base: str, with_line_id: bool = False) -> DataFrame:
    """Curated transaction lines (13 columns; ``transaction_line_id`` on request).

    The line id needs a global numbering (range shuffle + materialised
    intermediate), so analytic queries that never read it leave it out.
    """
    line_id = ["transaction_line_id"] if with_line_id else []
    joined = _numbered(spark, base, line_id[0], by_year=False, start=1) if with_line_id else _joined(spark, base)
    staged = joined.select(
        *line_id,
        _period().alias("source_period"),
        _invoice().alias("invoice_no"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_code"),
        F.when(F.col("l_partkey") % BLANK_DESCRIPTION_MOD == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_name"))
        .alias("description"),
        _signed_quantity().alias("quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_timestamp"),
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(0.0))
        .otherwise(F.col("p_retailprice"))
        .alias("unit_price"),
        F.when(F.col("o_orderpriority") == F.lit(UNSPECIFIED_PRIORITY), F.lit(None).cast("bigint"))
        .otherwise(F.col("o_custkey"))
        .alias("customer_id"),
        F.col("n_name").alias("country"),
    )
    return with_sale_flags(staged)


def raw_lines(spark: SparkSession, base: str) -> DataFrame:
    """All-text landing rows with seeded faults, numbered per period from 2."""
    numbered = _numbered(spark, base, "source_row", by_year=True, start=2)
    date_text = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    return numbered.select(
        _period().alias("source_period"),
        "source_row",
        _invoice().alias("Invoice"),
        F.concat(F.lit("  P"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("StockCode"),
        F.when(F.col("l_partkey") % BLANK_DESCRIPTION_MOD == 0, F.lit(""))
        .otherwise(F.col("p_name"))
        .alias("Description"),
        F.when(F.col("l_partkey") % BAD_QUANTITY_MOD == 0, F.lit("bad quantity"))
        .when(F.col("l_partkey") % BAD_QUANTITY_MOD == 1, F.lit("1.5"))
        .otherwise(_signed_quantity().cast("string"))
        .alias("Quantity"),
        F.when(F.col("l_suppkey") % BAD_DATE_MOD == 1, F.lit("not a date"))
        .otherwise(F.concat(date_text, F.lit(" " + LANDING_TIME)))
        .alias("InvoiceDate"),
        F.when(F.col("l_suppkey") % BAD_PRICE_MOD == 0, F.lit("NaN"))
        .when(F.col("l_suppkey") % BAD_PRICE_MOD == 1, F.lit("free"))
        .when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit("0"))
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("Price"),
        F.when(F.col("o_orderpriority") == F.lit(UNSPECIFIED_PRIORITY), F.lit(""))
        .when(F.col("o_custkey") % BAD_CUSTOMER_MOD == 0, F.lit("not-a-customer"))
        .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .alias("Customer ID"),
        F.col("n_name").alias("Country"),
    )


def landing_files(spark: SparkSession, rows: DataFrame) -> dict[str, str]:
    """``raw_lines`` rows as CSV files in the shared folder: period → its folder.

    Files follow one another by row number, and are compressed: their text is the
    largest thing that the job would write.  Every second period lists its
    columns in reverse; empty cells are missing ones when read again.
    """
    path = scratch_path(spark, "landing-files")
    row = F.col("source_row")
    found = rows.groupBy("source_period").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.max(row).alias("last"))
    stats = found.orderBy("source_period").collect()  # calendar years
    periods = [r.source_period for r in stats]
    for i, headers in enumerate((RAW_HEADERS, RAW_HEADERS[::-1])):
        # rows are numbered without gaps, so equal stretches of numbers hold equally many: no bounds to look for
        part, parts = F.lit(None).cast("int"), 0
        for r in stats[i::2]:
            pieces = -(-r.n // SORT_ROWS)
            if r["first"] is not None:
                at = F.floor((row - F.lit(r["first"])) / F.lit(r["last"] - r["first"] + 1) * F.lit(pieces)).cast("int")
                part = F.when(F.col("source_period") == F.lit(r.source_period), F.least(at, F.lit(pieces - 1)) + F.lit(parts)).otherwise(part)
            parts += pieces
        own = rows.where(F.col("source_period").isin(periods[i::2]))
        own = own.repartitionById(max(parts, 1), part).sortWithinPartitions("source_period", "source_row")
        out = own.select("source_period", *[F.col(f"`{h}`") for h in headers]).write.partitionBy("source_period").mode("append")
        # cells as they are, blanks around them too
        out.options(header="true", compression="gzip", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return {p: f"{path}/source_period={p}" for p in periods}
