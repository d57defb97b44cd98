"""Token-id packing into fixed-length rows, by best fit decreasing.

Documents are tokenised and cut into segments of at most ``length`` tokens, an
end-of-document id included, without losing any.  Segments are dealt at random
into packing groups of about ``GROUP_BYTES`` of text; inside a group they are
taken longest first, and a segment tree over free capacities finds the fullest
open row that still has room.  A group has a bounded number of segments however large the input is
and needs no knowledge of others; only its last, partly filled rows waste room.

A packed row has its ids (little-endian unsigned 16-bit, filled up with the
end id), the cumulative segment lengths, the position ids that restart with
every segment, and where each segment comes from.  Null texts count as empty:
such a document is one segment that holds the end id only.  Repeated rows are
packed each; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import corpora, encode_corpus, vocabulary

LENGTH = 2048
END_ID = 50256
GROUP_BYTES = 16 << 20
_ROWS = (
    "group long, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, "
    "position_ids binary, doc_ids array<long>, segment_numbers array<int>"
)
_ROWS_ARROW = pa.schema(
    [
        ("group", pa.int64()),
        ("row", pa.int32()),
        ("n_tokens", pa.int32()),
        ("n_segments", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_ids", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("segment_numbers", pa.list_(pa.int32())),
    ]
)


class Capacities:
    """Counts of open rows by free capacity, in a segment tree.

    ``take(n)`` finds the least free capacity of at least ``n`` that some open
    row has, in logarithmic time.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        node = self.leaves + least
        if not self.count[node]:
            # up to the first right sibling with an open row, then down to its least leaf
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of indices into ``sizes``, each of at most ``length`` in total."""
    rows: list[list[int]] = []
    free = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = free.take(sizes[i])
        if found is None:
            capacity, row = length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity - sizes[i]:
            free.put(capacity - sizes[i], row)
    return rows


def _row(group, row, parts: list[tuple[int, int, np.ndarray]], length: int, end: int) -> tuple:
    sizes = np.array([len(p[2]) for p in parts])
    ids = np.full(length, end, "<u2")
    positions = np.zeros(length, "<u2")
    total = int(sizes.sum())
    ids[:total] = np.concatenate([p[2] for p in parts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    positions[:total] = np.arange(total) - np.repeat(bounds[:-1], sizes)
    return (
        group, row, total, len(parts), ids.tobytes(), bounds.astype(np.int32), positions.tobytes(),
        [p[0] for p in parts], [p[1] for p in parts],
    )


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS_ARROW)], schema=_ROWS_ARROW)


def _segments(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for low, high, data, offsets in corpora(batch.column("text")):
                ids, at = encode_corpus(data, offsets, vocab)
                docs, keys = batch.column("doc_id").slice(low, high - low).to_pylist(), batch.column("deal").slice(low, high - low).to_pylist()
                out: list[tuple] = []
                for d in range(high - low):
                    own = np.append(ids[at[d] : at[d + 1]], end).astype("<u2")
                    for number, begin in enumerate(range(0, len(own), length)):
                        out.append((docs[d], number, keys[d], own[begin : begin + length].tobytes()))
                for first in range(0, len(out), 4096):
                    part = out[first : first + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[i] for p in part], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                        names=["doc_id", "number", "deal", "ids"],
                    )

    return run


def _pack(length: int, end: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        docs, numbers = table.column("doc_id").to_pylist(), table.column("number").to_pylist()
        cells = [np.frombuffer(c, "<u2") for c in table.column("ids").to_pylist()]
        # a fixed order, so that a task that runs again packs alike
        order = sorted(range(len(cells)), key=lambda i: (-len(cells[i]), docs[i] is None, docs[i] or 0, numbers[i], cells[i].tobytes()))
        rows = best_fit_decreasing([len(cells[i]) for i in order], length)
        return _table([_row(group, r, [(docs[order[i]], numbers[order[i]], cells[order[i]]) for i in row], length, end) for r, row in enumerate(rows)])

    return run


def pack_documents(
    docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """The packed rows of all documents; see the module's text for the columns."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))).alias("deal"),
    )
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = size // GROUP_BYTES + 1
    segments = texts.mapInArrow(_segments(path, length, end_id), "doc_id long, number int, deal long, ids binary")
    dealt = segments.select("doc_id", "number", "ids", F.pmod(F.xxhash64("deal", "number"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(_pack(length, end_id), _ROWS)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """The segments back from packed rows: ``doc_id, number, ids``."""
    spans = F.expr(
        "transform(sequence(0, n_segments - 1), i -> named_struct('doc_id', doc_ids[i], 'number', segment_numbers[i],"
        " 'ids', substring(ids, 2 * cu_seqlens[i] + 1, 2 * (cu_seqlens[i + 1] - cu_seqlens[i]))))"
    )
    return packed.select(F.explode(spans).alias("s")).select("s.*")
