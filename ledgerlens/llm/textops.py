"""Vectorised word and shingle hashing over Arrow string columns.

All helpers work on the raw UTF-8 buffer of an Arrow column, a few megabytes
at a time, so a Python worker's memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20
SPAN_BYTES = 1 << 16
SHINGLE_WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SLOTS = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=U64) * MULTIPLIER) | U64(1)
_INVERSE = U64(pow(int(MULTIPLIER), -1, 1 << 64))
_POWERS = {MULTIPLIER: np.ones(1, dtype=U64), _INVERSE: np.ones(1, dtype=U64)}


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    """At least ``n`` powers of the polynomial multiplier, or of its inverse, modulo 2**64."""
    if len(_POWERS[base]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        table = np.full(size, base, dtype=U64)
        table[0] = 1
        _POWERS[base] = np.multiply.accumulate(table)
    return _POWERS[base]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the ``n + 1`` offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, dtype=kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, local offsets) with about ``limit`` bytes each."""
    raw, offsets = buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the ``n + 1`` word offsets of the documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans.

    A span's polynomial is the difference of two running sums over the bytes,
    moved back to place 0 by the inverse power of its start.
    """
    total = np.empty(len(starts), U64)
    low = 0
    while low < len(starts):
        begin = int(starts[low])
        # a part that stays in the processor's cache, or one long span
        high = max(low + 1, int(np.searchsorted(ends, begin + SPAN_BYTES, side="right")))
        size = int(ends[high - 1]) - begin
        sums = np.zeros(size + 1, U64)
        np.cumsum((data[begin : begin + size].astype(U64) + U64(1)) * powers(size)[:size], out=sums[1:])
        first = starts[low:high] - begin
        total[low:high] = (sums[ends[low:high] - begin] - sums[first]) * powers(size, _INVERSE)[first]
        low = high
    return mix(total ^ ((ends - starts).astype(U64) * _SLOTS[0]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and word offsets."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(_LOWER[data], starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-word shingles and their offsets by document.

    A document of one to four words has one shingle, its whole sequence;
    a document without words has none.
    """
    k = SHINGLE_WORDS
    counts = np.diff(first)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(offsets[-1]), dtype=U64)
    if not len(out):
        return out, offsets
    long = counts >= k
    if long.any():
        span = len(words) - k + 1
        rolled = words[:span] * _SLOTS[0]
        for j in range(1, k):
            rolled = rolled + words[j : j + span] * _SLOTS[j]
        begin, size = first[:-1][long], each[long]
        lead = np.cumsum(size) - size
        index = np.arange(int(size.sum())) + np.repeat(begin - lead, size)
        target = np.arange(int(size.sum())) + np.repeat(offsets[:-1][long] - lead, size)
        out[target] = mix(rolled[index])
    for d in np.flatnonzero((counts > 0) & ~long):
        own = words[first[d] : first[d + 1]]
        total = (own * _SLOTS[: len(own)]).sum(dtype=U64, keepdims=True)
        out[offsets[d]] = mix(total ^ (np.array([len(own)], U64) * MULTIPLIER))[0]
    return out, offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    words, first = word_hashes(data, offsets)
    hashes, at = shingle_hashes(words, first)
    return [distinct(hashes[at[d] : at[d + 1]]) for d in range(len(offsets) - 1)]


def distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), dtype=bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def set_id(values: np.ndarray) -> np.int64:
    """A 64-bit identity of a set of hashes."""
    total = mix(values).sum(dtype=U64, keepdims=True) ^ (np.array([len(values)], U64) * MULTIPLIER)
    return mix(total).astype(np.int64)[0]
