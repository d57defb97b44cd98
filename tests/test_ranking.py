"""Distributed ranks and row numbers equal the built-in windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import (
    quantile_scores,
    row_number_by,
    row_number_by_position,
    score_breaks,
    window_quantile_scores,
)


def _random_metrics(spark, n, seed, hot_share=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot_share:
            rows.append((i, 7, 3, 99.99))  # one hot value holding a share of all rows
        else:
            rows.append((i, rng.randint(0, 40), rng.randint(1, 12), round(rng.uniform(0, 500), 2)))
    return spark.createDataFrame(rows, "id long, a long, b long, c double")


@pytest.mark.parametrize("seed,n,hot,buckets", [(1, 500, 0.0, 8), (2, 2000, 0.33, 16), (3, 1, 0.0, 4), (4, 2, 0.0, 4), (5, 300, 0.0, 1)])
def test_distributed_scores_equal_percent_rank_window(spark, seed, n, hot, buckets):
    df = _random_metrics(spark, n, seed, hot)
    cols, names, inv = ["a", "b", "c"], ["sa", "sb", "sc"], [True, False, False]
    got = quantile_scores(df, cols, names, inv, buckets=buckets).select("id", *names)
    want = window_quantile_scores(df, cols, names, inv).select("id", *names)
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_scores_of_awkward_values_equal_the_window(spark):
    rng = random.Random(6)
    wide = [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) * rng.random() for _ in range(400)] + [5e-324, 1e-323, 0.0, -0.0, 1.7e308, -1.7e308]
    values = [
        wide, [3.0] * 50, [1.0, 2.0], [7.0], [float(i) for i in range(11)], [1.0] * 99 + [2.0], [1.0] + [2.0] * 99,
        [0.1 + 0.2, 0.3] * 20, [1e300, 1e300 * (1 + 2**-52)] * 30, [rng.randint(0, 5) + 0.0 for _ in range(301)],
    ]
    for column in values:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(column)], "id long, x double").repartition(4)
        for buckets in (None, 3):
            got = quantile_scores(df, ["x"], ["s"], [False], buckets=buckets)
            want = window_quantile_scores(df, ["x"], ["s"], [False])
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (column[:5], buckets)


def test_few_steps_reach_the_breaks(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(round(rng.uniform(0, 1e5), 2),) for _ in range(20000)], "x double").cache()
    steps = []
    real = type(df).collect
    try:
        type(df).collect = lambda self: steps.append(1) or real(self)
        breaks = score_breaks(df, ["x"])["x"]
    finally:
        type(df).collect = real
    # a thousandth of the range for each step: 10,000,000 possible values need three
    assert len(breaks) == 5 and len(steps) <= 4


def test_scores_without_values_or_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, 9.0), (4, None)], "id long, x double")
    assert {r.id: r.s for r in quantile_scores(df, ["x"], ["s"]).collect()} == {1: None, 2: 1, 3: 5, 4: None}
    none = df.where("x is null")
    assert {r.s for r in quantile_scores(none, ["x"], ["s"]).collect()} == {None}
    with pytest.raises(ValueError, match="not finite"):
        quantile_scores(spark.createDataFrame([(float("inf"),), (1.0,)], "x double"), ["x"], ["s"])


def test_scores_plan_has_no_single_partition_exchange(spark):
    df = _random_metrics(spark, 200, 9)
    out = quantile_scores(df, ["a"], ["sa"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "Window" not in plan  # the scores are a CASE over the input rows


def test_row_number_by_matches_window(spark):
    df = _random_metrics(spark, 3000, 11, hot_share=0.3)
    got = row_number_by(df, ["a", "b", "c", "id"], name="rn", num_partitions=7)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("a", "b", "c", "id")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_row_number_by_partitioned_matches_window(spark):
    df = _random_metrics(spark, 2000, 12)
    got = row_number_by(df, ["c", "id"], name="rn", partition_by=["b"], start=2, num_partitions=5)
    w = Window.partitionBy("b").orderBy("c", "id")
    want = df.withColumn("rn", (F.row_number().over(w) + 1).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_row_number_by_position_matches_window(spark):
    rng = random.Random(5)
    rows = [(p, pos) for p in ("b", "a", "c") for pos in rng.sample(range(2, 5000), 400)]
    df = spark.createDataFrame(rows, "period string, pos long")
    got = row_number_by_position(df, "period", "pos", name="rn", rows_per_bucket=64)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("period", "pos")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == len(rows)


@pytest.mark.parametrize("seed,hot", [(21, 0.0), (22, 0.34)])
def test_rfm_scores_equal_window(spark, seed, hot):
    from ledgerlens.operators.rfm import rfm_scores

    metrics = _random_metrics(spark, 1500, seed, hot).selectExpr(
        "id AS customer_id", "a AS recency_days", "b AS frequency", "c AS monetary"
    )
    got = rfm_scores(metrics).select("customer_id", "r_score", "f_score", "m_score")
    want = rfm_scores(metrics, method="window").select("customer_id", "r_score", "f_score", "m_score")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
