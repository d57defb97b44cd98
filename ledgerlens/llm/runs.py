"""Periodic runs of words, from branching tandem repeats on an enhanced suffix array.

A run is a maximal stretch of words with a smallest period ``q``.  Some
megabytes of texts form one array of words in which equal words of different
texts are different symbols, so no repeat reaches over a text's end.

1. The suffix array comes from prefix doubling: only suffixes that share their
   first 1, 2, 4, ... words with another one are sorted again.  The ranks of
   each round give the LCP values afterwards, from the longest step down.
2. An LCP interval of depth ``d`` is a stretch of the array between two smaller
   values; its children lie between the values equal to ``d``.  For the suffixes
   ``i`` of all children but the largest, the inverse array tells whether
   ``i + d`` or ``i - d`` lies in the same interval.  If so, two equal blocks of
   ``d`` words stand side by side, and where the next word differs the square is
   a branching one: the right end of a run of period ``d``.
3. Squares are rotated to the left as long as words ``d`` apart are equal.  At
   one right end, a square inside the run of a smaller period belongs to that
   run and is not rotated.  What is left are the runs.

No interval is stored as a tree node; all steps are array operations over all
texts of a chunk.  A suffix lies in a child other than the largest at most
log2(n) times.

Defined cases: a null, empty or blank text has no words and no runs and its
collapsed text is empty; repeated rows stay, each with its own runs; an empty
table gives an empty one.  Only the id and the text column are read, so further
columns may have any name.  A text is taken whole, whatever its length: memory
grows with the longest text's words times log2 of its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import MULTIPLIER, U64, chunks, mix, span_hashes, word_spans

LEAST_WORDS = 6
LEAST_TIMES = 4
CORPUS_BYTES = 4 << 20
ROTATED_AT_ONCE = 32

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated_suffixes(symbol: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes whose first word occurs again, and the LCP of each with the one before.

    ``end`` is the end of each position's text; no symbol occurs in two texts.
    """
    n = len(symbol)
    order = np.argsort(symbol)
    head = np.ones(n, bool)
    head[1:] = symbol[order[1:]] != symbol[order[:-1]]
    single = head & np.append(head[1:], True)
    suffix, head = order[~single], head[~single]
    m = len(suffix)
    if not m:
        return suffix, np.zeros(0, np.int64)
    # the rank of a group is its first slot; words that occur once get ranks beyond all slots
    rank = np.empty(n, np.int64)
    rank[order[single]] = m + np.arange(n - m)
    rank[suffix] = np.maximum.accumulate(np.where(head, np.arange(m), 0))
    ranks, parted = [rank.astype(np.int32)], np.zeros(m, np.int8)
    slots, step = np.arange(m), 0
    while len(slots):
        own = suffix[slots]
        beyond = own + (1 << step)
        inside = beyond < end[own]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + n + 1, end[own])
        key = rank[own] * (2 * n + 1) + second
        order = np.argsort(key)
        own, key = own[order], key[order]
        suffix[slots] = own
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        parted[slots[head & (rank[own] != slots)]] = step + 1
        rank[own] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & np.append(head[1:], True))]
        ranks.append(rank.astype(np.int32))
        step += 1
    lcp = np.zeros(m, np.int64)
    for level in range(1, step + 1):
        # parted between 2**(level - 1) and 2**level words
        at = np.flatnonzero(parted == level)
        left, right = suffix[at - 1], suffix[at]
        shared = np.full(len(at), 1 << (level - 1))
        for finer in range(level - 2, -1, -1):
            x, y = left + shared, right + shared
            same = (x < end[left]) & (y < end[right])
            table = ranks[finer]
            same &= table[np.minimum(x, n - 1)] == table[np.minimum(y, n - 1)]
            shared += same << finer
        lcp[at] = shared
    return suffix, lcp


class NearestSmaller:
    """The nearest smaller values of an array on both sides, by halving steps over window minima."""

    def __init__(self, values: np.ndarray):
        heads = np.append(np.flatnonzero(values == 0), len(values))
        widest = int(np.diff(heads).max()) if len(heads) > 1 else 1
        self.levels = max(1, widest.bit_length())
        self.pad = 1 << self.levels
        zeros = np.zeros(self.pad, np.int32)
        window = np.concatenate([zeros, values.astype(np.int32), zeros])
        self.least = [window]
        for v in range(self.levels - 1):
            window = window.copy()
            np.minimum(window[: -(1 << v)], window[1 << v :], out=window[: -(1 << v)])
            self.least.append(window)

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place before ``at`` with a value below ``bound``."""
        p = at + self.pad
        for v in reversed(range(self.levels)):
            p = p - ((self.least[v][p - (1 << v)] >= bound).astype(np.int64) << v)
        return p - 1 - self.pad

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place after ``at`` with a value below ``bound``."""
        p = at + 1 + self.pad
        for v in reversed(range(self.levels)):
            p = p + ((self.least[v][p] >= bound).astype(np.int64) << v)
        return p - self.pad


def branching_squares(
    symbol: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, times: int
) -> tuple[np.ndarray, np.ndarray]:
    """Place and half length of the branching squares that can end a long enough run."""
    n = len(symbol)
    suffix, lcp = repeated_suffixes(symbol, end)
    none = np.zeros(0, np.int64)
    if not len(suffix):
        return none, none
    slot = np.full(n, -1, np.int64)
    slot[suffix] = np.arange(len(suffix))
    # a run of period d has times * d words at least
    split = np.flatnonzero((lcp > 0) & (lcp * times <= (end - start)[suffix]))
    if not len(split):
        return none, none
    depth = lcp[split].astype(np.int32)
    nearest = NearestSmaller(lcp)
    low, high = nearest.before(split, depth), nearest.after(split, depth)
    leftmost = nearest.before(split, depth + 1) == low
    # children: one right of each split, one more left of an interval's first
    begin = np.concatenate([split, low[leftmost]])
    stop = np.concatenate([nearest.after(split, depth + 1), split[leftmost]])
    low, high, depth = (np.concatenate([c, c[leftmost]]) for c in (low, high, depth.astype(np.int64)))
    interval = low * (n + 1) + depth
    order = np.lexsort((stop - begin, interval))
    smaller = order[:-1][interval[order[:-1]] == interval[order[1:]]]  # all but each interval's last, the largest
    begin, low, high, depth = begin[smaller], low[smaller], high[smaller], depth[smaller]
    size = stop[smaller] - begin
    lead = np.cumsum(size) - size
    own = suffix[np.arange(int(size.sum())) + np.repeat(begin - lead, size)]
    low, high, depth = (np.repeat(c, size) for c in (low, high, depth))
    places, halves = [], []
    for shift in (depth, -depth):
        other = own + shift
        at = slot[np.clip(other, 0, n - 1)]
        hit = (other >= 0) & (other < n) & (at >= low) & (at < high)
        places.append(np.minimum(own, other)[hit])
        halves.append(depth[hit])
    place, half = np.concatenate(places), np.concatenate(halves)
    # the next word differs, and the run can reach the least length to the left
    stop = place + 2 * half
    open_end = stop < end[place]
    keep = ~(open_end & (symbol[np.minimum(stop, n - 1)] == symbol[place + half]))
    first = stop - np.maximum(least, times * half)
    keep &= first >= start[place]
    place, half, first = place[keep], half[keep], first[keep]
    keep = (symbol[first] == symbol[first + half]) & (symbol[(first + place) // 2] == symbol[(first + place) // 2 + half])
    keep &= symbol[place - (first < place)] == symbol[place - (first < place) + half]
    pairs = np.unique(np.stack([place[keep] + 2 * half[keep], half[keep]], 1), axis=0)
    return pairs[:, 0] - 2 * pairs[:, 1], pairs[:, 1]


def rotated(symbol: np.ndarray, start: np.ndarray, place: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The first place to which each square rotates inside its text."""
    place = place.copy()
    floor = start[place] if len(place) else place
    active = np.arange(len(place))
    back = 1 + np.arange(ROTATED_AT_ONCE)
    while len(active):
        at = place[active][:, None] - back
        inside = at >= floor[active][:, None]
        at = np.maximum(at, 0)
        same = inside & (symbol[at] == symbol[at + half[active][:, None]])
        steps = np.where(same.all(axis=1), ROTATED_AT_ONCE, same.argmin(axis=1))
        place[active] -= steps
        active = active[steps == ROTATED_AT_ONCE]
    return place


def runs_of(
    symbol: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, by start, then period.

    ``first`` holds the ``n + 1`` word offsets of the texts in ``symbol``.  A
    run has at least ``least`` words and ``times`` periods; ``times`` is two or more.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    start, end = first[:-1][text], first[1:][text]
    own = mix(symbol + mix(text.astype(U64) + U64(1)) * MULTIPLIER)
    place, half = branching_squares(own, start, end, least, times)
    found = []
    # by right end, then period: each round takes the smallest period that is left at an end
    while len(place):
        stop = place + 2 * half
        head = np.ones(len(place), bool)
        head[1:] = stop[1:] != stop[:-1]
        reach = rotated(own, start, place[head], half[head])
        found.append(np.stack([reach, stop[head], half[head]], 1))
        covered = np.repeat(reach, np.diff(np.append(np.flatnonzero(head), len(place))))
        left = ~head & (place < covered)
        place, half = place[left], half[left]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text"), CORPUS_BYTES):
                starts, ends, first = word_spans(data, offsets)
                begin, stop, period = runs_of(span_hashes(data, starts, ends), first, least, times)
                at = np.searchsorted(begin, first)
                raw, edges, collapsed = data.tobytes(), offsets.tolist(), []
                for d in range(high - low):
                    words = raw[edges[d] : edges[d + 1]].split()
                    if at[d] < at[d + 1]:
                        turn = np.zeros(len(words) + 1, np.int64)
                        own = slice(at[d], at[d + 1])
                        np.add.at(turn, begin[own] + period[own] - first[d], 1)
                        np.add.at(turn, stop[own] - first[d], -1)
                        words = compress(words, (np.cumsum(turn[:-1]) == 0).tolist())
                    collapsed.append(b" ".join(words))
                base = np.repeat(first[:-1], np.diff(at))
                runs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - begin), pa.array(period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(np.diff(first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document; no shuffle.

    ``runs`` lists start, length and period in words, by start, then period;
    ``collapsed`` is the text's words, less those that stand in a run after the
    run's first period, joined by one space.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    runs = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return texts.mapInArrow(_found(least, times), f"doc_id long, n_words long, runs {runs}, collapsed string")


# by exact length / period, then the earliest, then the shortest period
_STRONGER = """array_sort(runs, (x, y) -> CASE
    WHEN x.length * y.period > y.length * x.period THEN -1
    WHEN x.length * y.period < y.length * x.period THEN 1
    WHEN x.start < y.start THEN -1
    WHEN x.start > y.start THEN 1
    WHEN x.period < y.period THEN -1
    WHEN x.period > y.period THEN 1
    ELSE 0 END)"""


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one and digests, from the columns of ``periodic_runs``."""
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("best", F.expr(f"get({_STRONGER}, 0)")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_cycles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of which about a tenth repeat a stretch of their words to the end.

    With ``h`` the CRC-32 of the decimal id and ``g = h div 10``, a text of ``n``
    words with ``h % 10 = 0`` goes on, from word ``a = g % n``, with the next
    ``1 + (n - a) div (3 + g % 8)`` words over and over.  Other texts, and those
    of a null id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    words = F.when(h % 10 == 0, F.expr(f"regexp_extract_all(`{text_col}`, '[^ \\\\x09-\\\\x0D]+', 0)"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.expr("0L").alias("g"), words.alias("words"))
    own = own.withColumn("g", F.expr("crc32(cast(doc_id as string)) div 10")).withColumn("n", F.size("words"))
    own = own.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    cycled = "concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))))"
    return own.select("doc_id", F.when(F.expr("n > 0"), F.expr(f"array_join(slice({cycled}, 1, n), ' ')")).otherwise(F.col("text")).alias("text"))
