"""The numbered fixture lines: narrow sorts of bounded size, and the numbers of a window."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import ranking
from ledgerlens.plans.datasets import session_dataset
from ledgerlens.sources import fixtures

KEY = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1995, 1, 1)
    orders = [(o, o % 7, None if o == 11 else day + dt.timedelta(days=o * 5), "4-NOT SPECIFIED" if o % 5 == 0 else "2-HIGH") for o in range(300)]
    lines = [
        (i % 300, i % 13, i % 9, i // 300, float(i % 6 + 1), 10.0 + i, i % 3 / 100, i % 2 / 100, "ARN"[i % 3], "FO"[i % 2], day)
        for i in range(2000)
    ]
    line_schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    for name, rows, schema in [
        ("lineitem", lines, line_schema),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
        ("part", [(p, f"part {p}", 900.0 + p) for p in range(13)], "p_partkey long, p_name string, p_retailprice double"),
        ("customer", [(c, c % 3) for c in range(7)], "c_custkey long, c_nationkey int"),
        ("nation", [(n, f"NATION_{n}") for n in range(3)], "n_nationkey int, n_name string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
    return base


@pytest.mark.parametrize("landing", [False, True])
def test_numbers_come_from_narrow_bounded_sorts(spark, tables, monkeypatch, landing):
    written = []
    real = ranking.materialize

    def seen(df, name):
        written.append((set(df.columns), df.rdd.getNumPartitions()))
        return real(df, name)

    monkeypatch.setattr(ranking, "materialize", seen)
    monkeypatch.setattr(ranking, "SORT_ROWS", 100, raising=False)
    got = fixtures.raw_lines(spark, tables) if landing else fixtures.retail_lines(spark, tables, with_line_id=True)
    (columns, parts), = written
    assert not columns & {"Invoice", "invoice_no", "line_revenue", "source_period"}  # derived afterwards
    assert parts == 20  # 2000 rows, 100 to a sort; 8 are set for shuffles
    joined = fixtures._joined(spark, tables)
    w = Window.orderBy(*fixtures.LINE_ORDER)
    key = F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("o_orderkey").cast("string"))
    if landing:
        w = Window.partitionBy(F.year("o_orderdate")).orderBy(*fixtures.LINE_ORDER)
        want = joined.select(key.alias("Invoice"), (F.row_number().over(w) + 1).cast("bigint").alias("source_row"), F.concat(F.lit("  P"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("StockCode"))
    else:
        want = joined.select(key.alias("invoice_no"), F.row_number().over(w).cast("bigint").alias("transaction_line_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_code"))
    got = got.select(*want.columns)
    assert got.count() == 2000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_stored_table_is_sorted_in_small_splits(spark):
    before, inside = spark.conf.get(KEY), []

    def build():
        inside.append(spark.conf.get(KEY))
        return spark.range(10).withColumn("invoice_timestamp", F.lit("2010-12-01").cast("timestamp_ntz"))

    assert session_dataset(spark, "small-splits", "key", build).count() == 10
    assert inside == ["12m"] and spark.conf.get(KEY) == before
