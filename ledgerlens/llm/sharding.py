"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Each record is hashed into one of ``SLOTS`` virtual slots for good.  One
grouped aggregate gives bytes and rows of each slot; the map assigns slots to
shards and is the only thing that is edited when shards are added or the load
shifts, so a rebalance moves whole slots and nothing else.  Maps are kept as a
table with a version column.

The map has ``SLOTS`` entries at any input size, so planning it on the driver
is bounded.  The law is ``bytes``: shard sizes are nearly equal, as close as
the slots (about a thousandth of a shard's bytes each) allow.

Records are hashed by id and text, so rows that share an id, or have none, are
spread by their texts.  Where copies of one row alone outweigh a mean slot, each
copy is hashed by its place in the input as well: such rows cannot be told apart,
so which copy goes to which slot makes no difference.  At most one such row for
each slot can exist, so their list is bounded at any input size.

All of it is DataFrame functions.  A null text has size 8 and the checksum of
no bytes; repeated rows are rows of their own.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

SLOTS = 4096
SHARDS = 24
ROWS_A_SPAN = 1 << 18


def record_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def _slot(hashed: Column, slots: int) -> Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def spread_copies(records: DataFrame, slots: int) -> DataFrame:
    """``records`` with ``hashed`` replaced by ``copy`` for rows whose copies outweigh a mean slot.

    ``records (hashed, copy, size)`` must be written already.  Only slots over
    twice the mean, in bytes or rows, can hold such copies; their rows are
    counted by hash, and what comes of it has at most two rows a slot.
    """
    loads = records.groupBy(_slot(F.col("hashed"), slots).alias("s")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    most = [max(1, sum(r[k] for r in loads) // slots) for k in ("b", "n")]
    heavy = [r.s for r in loads if r.b > 2 * most[0] or r.n > 2 * most[1]]
    if not heavy:
        return records
    suspects = records.where(_slot(F.col("hashed"), slots).isin(heavy)).groupBy("hashed").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    repeated = suspects.where((F.col("n") > 1) & ((F.col("b") > most[0]) | (F.col("n") > most[1])))
    hot = materialize(repeated.select("hashed", F.lit(True).alias("hot")), "shard-copies")
    if hot.isEmpty():
        return records
    marked = records.join(F.broadcast(hot), "hashed", "left")
    return marked.withColumn("hashed", F.when(F.col("hot"), F.col("copy")).otherwise(F.col("hashed"))).drop("hot")


def slot_loads(records: DataFrame) -> dict[int, int]:
    """Bytes of each non-empty slot of ``records (slot, size)``: at most ``SLOTS`` rows."""
    return {r.virtual_slot: r.n for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect()}


def plan_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The first map: largest slot first, always to the shard with the fewest bytes."""
    heap = [(0, 0, shard) for shard in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        size, held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + loads.get(slot, 0), held + 1, shard))
    return out


def rebalance(current: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """An edited map for new loads or more shards that moves few slots.

    Shards over the mean give their smallest-fitting slots to the shard with
    the fewest bytes, as long as that makes the two more even.  Slots of
    shards that no longer exist move first.
    """
    out = list(current)
    size = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    loose = []
    for slot, shard in enumerate(out):
        load = loads.get(slot, 0)
        if shard < shards:
            size[shard] += load
            held[shard].append((load, slot))
        else:
            loose.append((load, slot))
    for load, slot in sorted(loose, reverse=True):
        shard = min(range(shards), key=lambda s: (size[s], s))
        out[slot], size[shard] = shard, size[shard] + load
        held[shard].append((load, slot))
    while True:
        high = max(range(shards), key=lambda s: (size[s], -s))
        low = min(range(shards), key=lambda s: (size[s], s))
        gap = size[high] - size[low]
        fitting = [x for x in held[high] if 0 < x[0] < gap]
        if not fitting:
            return out
        move = min(fitting, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove(move)
        held[low].append(move)
        out[move[1]] = low
        size[high] -= move[0]
        size[low] += move[0]


def map_table(spark: SparkSession, shards: list[int], version: int) -> DataFrame:
    """``version, virtual_slot, shard``; append each version to the stored table."""
    return spark.range(len(shards)).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("virtual_slot"), _entry(shards, F.col("id")).alias("shard")
    )


def _entry(shards: list[int], slot: Column) -> Column:
    return F.get(F.from_json(F.lit(json.dumps(shards)), "array<int>"), slot.cast("int"))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> tuple[DataFrame, DataFrame]:
    """Placement of every record, and version 1 of the map.

    Placement: ``doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version``.  ``slot`` numbers the records of a shard from
    0 without gaps.  It comes from counts by virtual slot and span, added up
    over a shard, and a row number inside each span of about ``ROWS_A_SPAN``
    rows; no window holds a shard.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(id_col, text_col)
    written = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            record_size(text_col).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            hashed.alias("hashed"),
            F.xxhash64(hashed, F.monotonically_increasing_id()).alias("copy"),
        ),
        "shard-records",
    )
    dealt = spread_copies(written, slots)
    records = dealt.select(
        "doc_id", "size", "text_crc32", _slot(F.col("hashed"), slots).alias("virtual_slot"), F.shiftrightunsigned("hashed", 24).alias("spread")
    )
    loads = slot_loads(records)
    plan = plan_map(loads, shards, slots)
    spans = records.count() // (slots * ROWS_A_SPAN) + 1
    placed = records.withColumn("shard", _entry(plan, F.col("virtual_slot"))).withColumn(
        "span", F.pmod("spread", F.lit(spans)).cast("int")
    )
    # one row for each slot and span: their number, not the rows', is summed up
    counts = placed.groupBy("shard", "virtual_slot", "span").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("virtual_slot", "span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("virtual_slot", "span", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot", "span").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(inside)).join(before, ["virtual_slot", "span"])
    placement = numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(1).alias("map_version"),
    )
    return placement, map_table(spark, plan, 1)
