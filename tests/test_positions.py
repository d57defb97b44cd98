"""Numbers by position: equal to a window's, without a sort or an exchange of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import ranking


def _rows(seed: int, most: int, n: int, groups=("b", "a", None)):
    rng = random.Random(seed)
    return [(g, at, f"row {at}") for g in groups for at in rng.sample(range(-70, most), n)]


@pytest.mark.parametrize("most,n", [(3000, 2900), (200_000, 700)])
def test_numbers_equal_a_window_without_moving_rows(spark, most, n):
    df = spark.createDataFrame([*_rows(3, most, n), ("a", None, "no place")], "g string, at long, cell string")
    got = ranking.row_number_by_position(df, "g", "at", name="rn", start=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [coalesce(_rp_group" in plan
    moved = [line for line in plan.splitlines() if "Exchange hash" in line or "Exchange range" in line or "Sort [" in line]
    assert not [line for line in moved if "_rp_group" in line]
    w = Window.orderBy("g", "at")
    want = df.where("at is not null").withColumn("rn", (F.row_number().over(w) + 4).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_numbers_by_key_join_and_of_repeated_positions(spark, monkeypatch):
    df = spark.createDataFrame(_rows(4, 40_000, 900), "g string, at long, cell string")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("g", "at")).cast("bigint"))
    monkeypatch.setattr(ranking, "MARK_ROWS", 0)
    got = ranking.row_number_by_position(df, "g", "at", name="rn")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    twice = ranking.row_number_by_position(df.unionAll(df), "g", "at", name="rn")
    assert sorted(r.rn for r in twice.select("rn").collect()) == list(range(1, 2 * df.count() + 1))
    assert ranking.row_number_by_position(df.where("at > 90000"), "g", "at").count() == 0
