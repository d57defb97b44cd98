"""N-gram Jaccard join of documents: size-banded tiles, bitmap bounds, exact sets.

A document's set holds the hashes of its distinct 5-word shingles (see
``textops``).  Documents with equal sets are one item from the start, so
copies are never expanded.  An item posts its prefix: ordered by a common
order, an item shares at least one of its first ``size - ceil(0.8 * size) + 1``
elements with each partner.  In that order frequent elements come last, so
lines and passages that many documents share rarely make a tile.  How frequent
an element is counts only for the order, never for the result: the list of the
``HOT_ELEMENTS`` most frequent ones has a fixed size and is the only thing that
is broadcast.  ``simjoin`` does the rest.

Null or blank texts have no shingles and are linked with nothing; repeated rows
are copies; a null ``doc_id`` counts for nothing in a component's least id.
Only ``doc_id`` and the text column are read, so further columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .keyfilter import key_bitmap, wanted
from .rows import free_name, row_key
from .simjoin import MEMBER, POSTING, bucket_rows, linked_components, parity_bitmap, tile_table
from .textops import U64, chunks, mix, set_id, shingle_sets
from .workers import released

HOT_ELEMENTS = 1 << 18
HOT_IN_BATCH = 4
BUCKET_BYTES = 16 << 20

_PROFILE = pa.schema(
    [("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("sid", pa.int64()), ("size", pa.int32()), ("bits", pa.binary())]
)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document's set id, size and bitmap.  Kind 1: an element and its count here."""
    for batch in batches:
        text, seen, pooled = batch.column("text"), set(), []
        for low, high, data, offsets in chunks(text):
            sids, sizes, bits = [], [], []
            for values in shingle_sets(data, offsets):
                sizes.append(len(values))
                if not len(values):
                    sids.append(None)
                    bits.append(None)
                    continue
                sids.append(int(set_id(values)))
                bits.append(parity_bitmap(values))
                if sids[-1] not in seen:
                    seen.add(sids[-1])
                    pooled.append(values)
            own = [batch.column(c).slice(low, high - low) for c in ("key", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(high - low, np.int32)), *own, pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())],
                schema=_PROFILE,
            )
        if pooled:
            values = np.concatenate(pooled)
            pooled.clear()
            values.sort()
            # an element that occurs so often equals the one that many places on
            before = values[: max(0, len(values) - HOT_IN_BATCH + 1)]
            often = np.unique(before[before == values[len(values) - len(before) :]])
            count = np.searchsorted(values, often, "right") - np.searchsorted(values, often, "left")
            n = len(often)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(n, np.int32)),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int64()),
                    pa.array(often.astype(np.int64)),
                    pa.array(count.astype(np.int32)),
                    pa.nulls(n, pa.binary()),
                ],
                schema=_PROFILE,
            )


def _postings(hot: np.ndarray, rank: np.ndarray, buckets: int):
    """Packed prefixes; ``hot`` are the frequent elements, ascending, ``rank`` their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, cold, cold_tok, often = set(), [], [], []
            for _, _, data, offsets in chunks(batch.column("text")):
                for values in shingle_sets(data, offsets):
                    size = len(values)
                    if not size:
                        continue
                    sid = set_id(values)
                    if int(sid) in seen:
                        continue
                    seen.add(int(sid))
                    at = np.searchsorted(hot, values)
                    at[at == len(hot)] = 0
                    is_hot = hot[at] == values if len(hot) else np.zeros(size, bool)
                    prefix = size - (4 * size + 4) // 5 + 1
                    rare = values[~is_hot]
                    own = rare[:prefix].copy()  # a view would keep the whole set
                    rows = np.empty(len(own), POSTING)
                    rows["tok"], rows["sid"], rows["size"] = own & U64(0xFFFFFFFF), sid, size
                    rows["posted"] = min(len(own), 65535)
                    cold.append(rows)
                    cold_tok.append(own)
                    if len(own) < prefix:
                        frequent = np.argsort(rank[at[is_hot]], kind="stable")
                        tail = values[is_hot][frequent][: prefix - len(own)]
                        rows = np.empty(len(tail), MEMBER)
                        place = len(own) + np.arange(len(tail))
                        rows["tok"], rows["sid"], rows["size"] = tail.astype(np.int64), sid, size
                        # at this place, partners can have at most so many elements
                        rows["most"] = 9 * (size - place) // 4 - size
                        rows["rare"] = 255 * len(rare) // size
                        often.append(rows[rows["most"] >= (4 * size + 4) // 5])
            keys, cells = [], []
            if cold:
                keys, cells = bucket_rows(np.concatenate(cold), np.concatenate(cold_tok), buckets)
            if often:
                rows = np.concatenate(often)
                more = bucket_rows(rows, mix(rows["sid"].astype(U64)), buckets, first=buckets)
                keys, cells = keys + more[0], cells + more[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array(cells, pa.binary())], names=["bucket", "payload"]
            )

    return run


def _sets(bitmap: np.ndarray):
    """The sets of those documents whose row key may be wanted; only these are hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            may_be = wanted(bitmap, batch.column("key").to_numpy())
            for _, _, data, offsets in chunks(batch.column("text").filter(pa.array(may_be))):
                sids, cells = [], []
                for values in shingle_sets(data, offsets):
                    if not len(values):
                        continue
                    sid = set_id(values)
                    if int(sid) not in seen:
                        seen.add(int(sid))
                        sids.append(int(sid))
                        cells.append(values.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(cells, pa.binary())], names=["sid", "elements"])

    return run


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id, set_id, copies, key``.

    ``component_id`` is the least ``doc_id`` that links reach, the document's
    own included; ``copies`` counts the documents with the same set; ``key``
    is ``row_key``.
    """
    spark = docs.sparkSession
    key = row_key(id_col, text_col).alias("key")
    texts = docs.select(key, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = materialize(texts.mapInArrow(released(_profiles), "kind int, key long, doc_id long, sid long, size int, bits binary"), "join-profile")
    rows = profile.where("kind = 0")
    shingles = rows.agg(F.sum("size").alias("n")).first().n or 0
    frequent = (
        profile.where("kind = 1")
        .groupBy("sid")
        .agg(F.sum("size").alias("n"))
        .orderBy(F.desc("n"), "sid")
        .limit(HOT_ELEMENTS)
        .select("sid")
        .toArrow()
    )
    hot = frequent.column("sid").to_numpy().astype(U64)
    rank = np.arange(len(hot))[::-1]  # the most frequent last
    order = np.argsort(hot)
    hot, rank = hot[order], rank[order]
    buckets = int(max(shuffle_partitions(spark), 0.2 * shingles * POSTING.itemsize // BUCKET_BYTES))
    tiles = tile_table(texts.select("text").mapInArrow(released(_postings(hot, rank, buckets)), "bucket int, payload binary"), buckets, "join")
    grouped = rows.where("sid is not null").groupBy("sid")
    items = materialize(grouped.agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("key")), "join-items")

    def sets_of(ends: DataFrame) -> DataFrame:
        """Sets by one document of each, found by its row key."""
        bitmap = key_bitmap(items.join(ends, "sid", "left_semi"), "key")
        return texts.select("key", "text").mapInArrow(released(_sets(bitmap)), "sid long, elements binary")

    labels = linked_components(tiles, items.select("sid", "size", "bits"), sets_of, "join")
    named = items.select("sid", "least", "copies").join(labels.withColumnRenamed("id", "sid"), "sid", "left")
    named = named.withColumn("label", F.coalesce("label", "sid"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    classes = named.join(least, "label").select("sid", "component", "copies")
    joined = rows.select("key", "doc_id", "sid", "size").join(classes, "sid", "left")
    return joined.select(
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("sid").alias("set_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "key",
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least id, then least key, of each component; columns unchanged.

    Documents without words are linked with nothing and all stay.
    """
    rows = materialize(ngram_jaccard_components(docs, id_col, text_col).where("set_id is not null"), "join-rows")
    least = F.min_by("key", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("key")))
    # the component of rows without any id is null; their sets tell them apart
    group = [F.coalesce("component_id", "set_id").alias("c"), F.col("component_id").isNull().alias("blank")]
    named = rows.select("key", "doc_id", *group)
    kept = named.groupBy("c", "blank").agg(least.alias("kept"))
    losers = named.join(kept, ["c", "blank"]).where("key <> kept").select("key").distinct()
    again = rows.groupBy("key").count().where("count > 1").select("key")
    key = free_name(docs, "_key")
    marked = docs.withColumn(key, row_key(id_col, text_col))
    losers, again = (d.withColumnRenamed("key", key) for d in (losers, again))
    left = marked.join(losers, key, "left_anti")
    once = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return once.drop(key)

