"""SQL path (registered view + parameterised SQL) equals the DataFrame path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.numeric import format_currency, format_integer
from ledgerlens.operators import sales
from ledgerlens.operators.rfm import customer_metrics, customer_segments
from ledgerlens.operators.sales import filtered_sales
from ledgerlens.plans.sql import customer_segments_sql, register, register_functions, run_sql, sales_filter_sql
from ledgerlens.sources.fixtures import retail_lines


def test_parameterised_sql_matches_dataframe_filter(spark, sf_small):
    lines = retail_lines(spark, sf_small)
    register(lines, "retail_transactions")
    cond, args = sales_filter_sql("1996-01-01", "1998-12-31", ["NATION_1", "NATION_2"])
    via_sql = run_sql(
        spark,
        f"SELECT COUNT(*) AS n, COUNT(DISTINCT invoice_no) AS orders FROM retail_transactions WHERE {cond}",
        args,
    ).first()
    df = sales.filtered_sales(lines, "1996-01-01", "1998-12-31", ["NATION_1", "NATION_2"])
    assert (via_sql["n"], via_sql["orders"]) == (df.count(), df.select("invoice_no").distinct().count())
    single_day, day_args = sales_filter_sql("1997-03-04", valid_sales_only=False)
    n = run_sql(spark, f"SELECT COUNT(*) FROM retail_transactions WHERE {single_day}", day_args).first()[0]
    assert n == sales.filtered_sales(lines, "1997-03-04", valid_sales_only=False).count()


def test_display_formats_follow_python(spark):
    values = [1234.5, 0.5, 1.5, 2.5, 20972594.55, 999.99]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(format_integer("x").alias("i"), format_currency(F.col("x")).alias("c")).collect()
    assert [r["i"] for r in got] == [f"{int(v):,}" for v in values]
    assert [r["c"] for r in got] == [f"GBP {v:,.0f}" for v in values]


def _functions(spark, sf_small, tmp_path):
    path = str(tmp_path / "lines.parquet")
    retail_lines(spark, sf_small).write.parquet(path)
    lines = spark.read.parquet(path)
    assert register_functions(lines) == ["filtered_sales", "customer_metrics", "rfm_score", "rfm_segment"]
    return lines


def _same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (df.select(sorted(df.columns)) for df in (a, b))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_sql_functions_equal_the_operators(spark, sf_small, tmp_path):
    lines = _functions(spark, sf_small, tmp_path)
    countries = ["NATION_1", "NATION_2", "NATION_3"]
    for chosen in ([], countries):
        sales = filtered_sales(lines, "1996-01-01", "1998-12-31", chosen)
        listed = "array(" + ", ".join(f"'{c}'" for c in chosen) + ")" if chosen else "NULL"
        _same(run_sql(spark, f"SELECT * FROM filtered_sales(DATE'1996-01-01', DATE'1998-12-31', {listed})"), sales)
        _same(run_sql(spark, f"SELECT * FROM customer_metrics(DATE'1996-01-01', DATE'1998-12-31', {listed})"), customer_metrics(sales, "1998-12-31"))
        _same(customer_segments_sql(spark, "1996-01-01", "1998-12-31", chosen), customer_segments(sales, "1998-12-31"))


def test_the_date_test_of_the_sql_function_is_pushed_to_the_reader(spark, sf_small, tmp_path, capsys):
    _functions(spark, sf_small, tmp_path)
    plan = run_sql(spark, "SELECT invoice_no FROM filtered_sales(DATE'1996-01-01', DATE'1996-12-31', NULL)")
    plan.explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(invoice_timestamp,1996-01-01" in text and "LessThan(invoice_timestamp,1997-01-01" in text
    assert "Python" not in text


def test_sql_scores_and_segments_by_hand(spark, sf_small, tmp_path):
    _functions(spark, sf_small, tmp_path)
    row = run_sql(
        spark,
        "SELECT rfm_score(3, array(1, 3, 5, NULL), false) a, rfm_score(3, array(1, 3, 5, NULL), true) b, rfm_score(NULL, array(1), false) c,"
        " rfm_score(0, array(1, 3, 5, 9), true) d, rfm_segment(5, 5) e, rfm_segment(1, 1) f, rfm_segment(3, 1) g",
    ).first()
    assert tuple(row) == (3, 3, None, 5, "Champions", "Hibernating", "Needs attention")
