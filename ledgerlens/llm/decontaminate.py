"""Benchmark decontamination by the q-gram lemma.

A passage that equals a benchmark item of ``m`` characters up to ``k`` edits
shares at least ``m - q + 1 - k * q`` of the item's q-grams with it, and they
lie within ``k`` of one diagonal.  Whole texts are scanned for the items'
q-grams; hits are counted in bands of diagonals that overlap by half, so one
band holds all of an occurrence's; bands that reach the bound are verified by
a banded alignment of the whole item.  Characters are compared with A-Z
lower-cased and white space as a plain space, one to one, so positions are
those of the text.

The items' q-grams go to the tasks in blocks of at most ``BLOCK_CHARS``
characters of benchmark, one scan of the texts for each block: what is sent has
a fixed bound however large the benchmark is.  Documents are never shuffled.

An item's edit budget is ``EDIT_SHARE`` of its length, or the most edits that leave
the bound positive: 0 below 20 characters.  Items shorter than ``q`` are searched
exactly, and where such an item begins or ends with a letter or digit, a word must
begin or end there.  Null texts and null or blank items match nothing; repeated
rows are reported each.

Very long and repetitive texts: hits are counted in slices of ``SLICE`` pairs of a
hit and a place in an item, so memory grows with the bands, not with such pairs.
Where an item stands unchanged in a retained band, its exact places are taken
first, and bands that leave no room for another place are not aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U64, mix
from .workers import released

Q = 10
EDIT_SHARE = 0.08
BLOCK_CHARS = 1 << 20
CHUNK_CHARS = 1 << 18
ROWS = 1 << 9  # texts that are taken out of Arrow at a time
FILTER_BITS = 22
SLICE = 1 << 18
BATCH_CELLS = 1 << 14
LOOK_ROWS = 16
FAR = 1 << 28  # more than any distance, and far enough from the end of 32 bits
_FOUND = "doc_id long, item_id long, start long, end long, distance int"
_FOUND_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]
)


def plain(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and white space as U+0020."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    x[(x >= 65) & (x <= 90)] += 32
    x[((x >= 9) & (x <= 13)) | (x == 0xA0)] = 32
    return x


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    wide = x.astype(U64)
    for j in range(q):
        out = out * U64(0x100000001B3) + wide[j : j + n]
    return mix(out)


class Items:
    """One block of the benchmark, ready for the scan."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, share: float = EDIT_SHARE):
        self.ids = np.array(ids, np.int64)
        self.plain = [plain(t) for t in texts]
        length = np.array([len(p) for p in self.plain], np.int64)
        most = np.maximum(0, (length - q) // q)  # the bound stays positive
        self.edits = np.minimum(np.floor(length * share).astype(np.int64), most)
        self.bound = np.maximum(1, length - q + 1 - self.edits * q)
        hashes = [grams(p, q) for p in self.plain]
        self.keys = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        self.place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.item, self.place = self.keys[order], self.item[order], self.place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.short = [i for i, p in enumerate(self.plain) if 0 < len(p) < q]
        self.length = length


def alignments(jobs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[int, int, int] | None]:
    """:func:`alignment` of every (item, region, edits), many at a time.

    They go in batches of like size, of at most ``BATCH_CELLS`` cells a row of the
    alignment (or one alignment), whose rows are computed together.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(jobs)
    sizes = [(len(item), len(region) - len(item) + 2 * edits + 1, k) for k, (item, region, edits) in enumerate(jobs)]
    batch: list[int] = []
    widest = 0
    for _, width, k in sorted(s for s in sizes if s[1] > 0):
        if batch and (len(batch) + 1) * max(widest, width) > BATCH_CELLS:
            _aligned(jobs, batch, out)
            batch, widest = [], 0
        batch.append(k)
        widest = max(widest, width)
    if batch:
        _aligned(jobs, batch, out)
    return out


def alignment(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the best place of ``item`` in ``region``, within ``edits``.

    The band holds every start in the region: ``region`` spans the item and
    twice the band of diagonals.  Free ends in the region, none in the item.
    """
    return alignments([(item, region, edits)])[0]


def _aligned(jobs: list[tuple[np.ndarray, np.ndarray, int]], batch: list[int], out: list[tuple[int, int, int] | None]) -> None:
    """Fill in ``out`` for one batch; alignments that can no longer keep their edits are left early."""
    which = np.array(batch)
    m, n, edits = (np.array(v, np.int32) for v in zip(*((len(i), len(r), e) for i, r, e in (jobs[k] for k in batch))))
    width = n - m + 2 * edits + 1  # diagonals from -edits to n - m + edits
    wide, rows = int(width.max()), int(m.max())
    j = np.arange(wide, dtype=np.int32)
    # column of diagonal d in row i: i + d - edits, at place i + d here
    column = np.arange(rows + wide + 1, dtype=np.int32) - edits[:, None]
    text = np.full(column.shape, -1, np.int64)
    letters = np.full((len(batch), rows), -2, np.int64)
    for row, k in enumerate(batch):
        item, region, own = jobs[k]
        text[row, own + 1 : own + 1 + len(region)] = region[: max(0, column.shape[1] - own - 1)]
        letters[row, : len(item)] = item
    first = np.where((column >= 1) & (column <= n[:, None]), 0, FAR).astype(np.int32)
    within, banded = (column >= 0) & (column <= n[:, None]), j < width[:, None]
    cost = np.where(within[:, :wide] & banded, 0, FAR).astype(np.int32)
    begin = np.maximum(j - edits[:, None], 0)
    for i in range(1, rows + 1):
        step = cost + (text[:, i : i + wide] != letters[:, i - 1 : i])
        step += first[:, i : i + wide]
        drop = np.full_like(cost, FAR)  # the item's character left out
        np.add(cost[:, 1:], 1, out=drop[:, :-1])
        take = drop < step
        new = np.where(take, drop, step)
        came = begin.copy()
        came[:, :-1][take[:, :-1]] = begin[:, 1:][take[:, :-1]]
        # the text's character left out: from the diagonal before, one more each
        slid = new - j
        best = np.minimum.accumulate(slid, axis=1)
        lead = np.maximum.accumulate(np.where(slid == best, j, 0), axis=1)
        cost = np.where(within[:, i : i + wide] & banded, best + j, FAR)
        begin = np.take_along_axis(came, lead, axis=1)
        done = m == i
        if done.any():
            for row in np.flatnonzero(done).tolist():
                end = int(np.argmin(cost[row]))
                distance = int(cost[row, end])
                if distance <= edits[row]:
                    out[which[row]] = (distance, int(begin[row, end]), i + end - int(edits[row]))
        elif i % LOOK_ROWS:
            continue
        stay = ~done & (cost.min(axis=1) <= edits)
        if not stay.all():
            if not stay.any():
                return
            which, m, edits, banded, text, letters, first, within, cost, begin = (
                v[stay] for v in (which, m, edits, banded, text, letters, first, within, cost, begin)
            )


def _regions(x: np.ndarray, doc: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, low, high) of the places that reach the bound."""
    keys = grams(x)
    hit = np.flatnonzero(items.filter[(keys >> U64(64 - FILTER_BITS)).astype(np.int64)]) if len(keys) else np.zeros(0, np.int64)
    if not len(hit):
        return
    hit = hit[doc[np.minimum(hit + Q - 1, len(doc) - 1)] == doc[hit]]
    low, high = np.searchsorted(items.keys, keys[hit]), np.searchsorted(items.keys, keys[hit], side="right")
    hit, low, times = hit[high > low], low[high > low], (high - low)[high > low]
    if not len(hit):
        return
    offset = len(x)
    bands, counts = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    upto = np.cumsum(times)
    begin = 0
    while begin < len(hit):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE, side="right")))
        part = times[begin:stop]
        at = np.repeat(hit[begin:stop], part)
        entry = np.arange(len(at)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(low[begin:stop], part)
        item = items.item[entry]
        # each diagonal is in two bands of twice the span
        band = (at - items.place[entry] + offset) // (items.edits[item] + 1)
        bands, counts = _summed(
            np.concatenate([bands, np.stack([doc[at], item, band], 1), np.stack([doc[at], item, band - 1], 1)]),
            np.concatenate([counts, np.ones(2 * len(at), np.int64)]),
        )
        begin = stop
    for d, i, b in bands[counts >= items.bound[bands[:, 1]]].tolist():
        edits = int(items.edits[i])
        first = b * (edits + 1) - offset
        yield d, i, max(int(starts[d]), first - edits), min(int(starts[d + 1]), first + 2 * (edits + 1) + int(items.length[i]) + edits)


def _summed(bands: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``bands`` in order, and the sums of their counts."""
    order = np.lexsort((bands[:, 2], bands[:, 1], bands[:, 0]))
    bands, counts = bands[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], (bands[1:] != bands[:-1]).any(1)]))
    return bands[head], np.add.reduceat(counts, head)


def _exact_places(item: np.ndarray, x: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Places of ``item`` in ``x[low:high]``, from the left, none over another."""
    needle, hay, at = item.tobytes(), x[low:high].tobytes(), 0
    while (at := hay.find(needle, at)) >= 0:
        if at % 4:
            at += 1
            continue
        yield low + at // 4, low + at // 4 + len(item)
        at += len(needle)


def _places(item: np.ndarray, edits: int, x: np.ndarray, regions: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Exact places in the regions (ascending) of one item in one text, and the regions to align."""
    exact: list[tuple[int, int]] = []
    for low, high in regions:
        exact.extend(_exact_places(item, x, max(low, exact[-1][1] if exact else low), high))
    begins = np.array([a for a, _ in exact], np.int64)
    ends = np.array([b for _, b in exact], np.int64)
    room = []
    for low, high in regions:
        # the widest gap between exact places that the region has room in
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(begins, high)
        left = np.concatenate([[low], ends[first:last]])
        right = np.concatenate([begins[first:last], [high]])
        if (right - left).max() >= len(item) - edits:
            room.append((low, high))
    return exact, room


def _stands_alone(item: np.ndarray, x: np.ndarray, at: int) -> bool:
    """Whether no word goes on past an end of the item at ``x[at]``."""
    end = at + len(item)
    before = at > 0 and chr(item[0]).isalnum() and chr(x[at - 1]).isalnum()
    after = end < len(x) and chr(item[-1]).isalnum() and chr(x[end]).isalnum()
    return not (before or after)


def find_items(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document index, item index, begin, end, distance), the best of overlapping places."""
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") <= CHUNK_CHARS):
            size += len(texts[high] or "")
            high += 1
        parts = [plain(t or "") for t in texts[low:high]]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        x = np.concatenate(parts)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, i, begin, stop in sorted(set(_regions(x, doc, starts, items))):
            regions.setdefault((d, i), []).append((begin, stop))
        waiting: list[tuple[int, int, int]] = []
        jobs: list[tuple[np.ndarray, np.ndarray, int]] = []
        for (d, i), own in regions.items():
            shift = int(starts[d])
            exact, room = _places(items.plain[i], int(items.edits[i]), x, own)
            for a, b in exact:
                out.setdefault((low + d, i), []).append((0, a - shift, b - shift))
            for begin, stop in room:
                waiting.append((d, i, begin - shift))
                jobs.append((items.plain[i], x[begin:stop], int(items.edits[i])))
        for (d, i, at), found in zip(waiting, alignments(jobs)):
            if found:
                out.setdefault((low + d, i), []).append((found[0], found[1] + at, found[2] + at))
        for i in items.short:
            needle = items.plain[i].tobytes()
            for d, p in enumerate(parts):
                hay, at = p.tobytes(), -1
                while (at := hay.find(needle, at + 1)) >= 0:
                    if at % 4 == 0 and _stands_alone(items.plain[i], p, at // 4):
                        out.setdefault((low + d, i), []).append((0, at // 4, at // 4 + len(items.plain[i])))
        low = high
    result = []
    for (d, i), places in out.items():
        taken: list[tuple[int, int]] = []
        for distance, a, b in sorted(set(places)):
            if all(b <= c or a >= e for c, e in taken):
                taken.append((a, b))
                result.append((d, i, a, b, distance))
    return sorted(result)


def _scan(ids: list[int], texts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts)
        for batch in batches:
            docs, rows = batch.column("doc_id").to_pylist(), []
            for low in range(0, batch.num_rows, ROWS):
                found = find_items(batch.column("text").slice(low, ROWS).to_pylist(), items)
                rows += [(docs[low + d], int(items.ids[i]), a, b, e) for d, i, a, b, e in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND_ARROW)], schema=_FOUND_ARROW)

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of at most ``BLOCK_CHARS`` characters, one at a time."""
    rows = (
        benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .where("id is not null and length(trim(text)) > 0")
        .orderBy("id", "text")
    )
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in rows.toLocalIterator():
        if ids and size + len(row.text) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield ids, texts


def contaminated_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, start, end, distance``: places of benchmark items in the texts, in characters."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    scans = [texts.mapInArrow(released(_scan(*block)), _FOUND) for block in item_blocks(benchmark, item_col, item_text)]
    if not scans:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionByName, scans)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, columns unchanged."""
    names = docs.columns
    out = docs.toDF(*[str(i) for i in range(len(names))])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for ids, texts in item_blocks(benchmark, "item_id", "text"):
        out = out.mapInArrow(released(_drop_hit(ids, texts, names.index(text_col))), schema)
    return out.toDF(*names)


def _drop_hit(ids: list[int], texts: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts)
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for low in range(0, batch.num_rows, ROWS):
                for found in find_items(batch.column(text_at).slice(low, ROWS).to_pylist(), items):
                    hit[low + found[0]] = True
            yield batch.filter(pa.array(~hit))

    return run
