"""Rows and files that the steps of the similarity join make."""

from __future__ import annotations

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import simjoin
from ledgerlens.llm.components import components
from ledgerlens.session import materialize


def test_large_tiles_of_a_bucket_with_one_least_member_are_one_tile():
    sids = np.array([-7, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    rows = np.zeros(0, simjoin.POSTING)
    # twenty tiles begin with -7, some of them without 144; ten others begin with 3
    for tok in range(30):
        own = sids[1:] if tok >= 20 else sids[: 10 - tok % 2]
        part = np.zeros(len(own), simjoin.POSTING)
        part["tok"], part["sid"], part["size"], part["posted"] = tok, own, 100, 21
        rows = np.concatenate([rows, part])
    table = pa.table({"bucket": pa.array([4], pa.int32()), "payload": pa.array([rows.tobytes()], pa.binary())})
    out = simjoin._reduce_tiles(9)((pa.scalar(4),), table).to_pylist()
    tiles = {}
    for r in out:
        assert (r["kind"], r["size"], r["most"], r["rare"]) == (1, 100, 125, simjoin.UNCOUNTED)
        tiles.setdefault(r["a"], []).append(r["b"])
    assert sorted(map(sorted, tiles.values())) == [sorted(sids.tolist()), sorted(sids[1:].tolist())]
    assert len(out) == 19


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    end = time.monotonic() + 20
    while _shuffle_files(spark) > before and time.monotonic() < end:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert out.count() == 7


def test_components_keep_one_round(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    found = components(links, "onechain")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.startswith("onechain")]) == 1
    assert {(r.id, r.label) for r in found.collect()} == {(i, 0) for i in range(41)}
