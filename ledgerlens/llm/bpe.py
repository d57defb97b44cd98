"""Byte-level BPE by corpus-level merge replay.

Each batch of documents is one corpus: its texts are split into pieces as the
tokenizer's pattern does.  Its distinct short pieces are the rows of matrices, by
length: each round merges the leftmost pair of lowest rank of every row, so a piece
of ``n`` bytes takes ``n - 1`` rounds at most.  The distinct longer pieces are laid
out in one array of symbols, and an inverted index from merge rank to positions
replays the merges.  The lowest rank that any position holds is taken from a heap; in every piece
its leftmost position is merged and only the two touched neighbours get new
ranks.  A merge may create a pair of a lower rank, which the heap then serves
first, so each piece sees the merges in the order in which the encoder applies
them to the piece alone.  Encoding needs no shuffle.

The vocabulary file's path is a parameter; it is read on the executors, once
for each Python worker.  A null text is an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import free_name
from .textops import U64, buffers, span_hashes
from .workers import released

CORPUS_BYTES = 4 << 20
SHORT_BYTES = 32
ROUND_CELLS = 1 << 15
NO_RANK = np.iinfo(np.int32).max
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")  # fixed by the pattern
# fixed values: the code points of Unicode's White_Space property
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, space or other for every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    whole = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for run in regex.finditer(rf"\p{{{name}}}+", whole):
            table[np.frombuffer(run.group().encode("utf-32-le"), "<u4")] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each UTF-8 byte belongs to."""
    table = _classes()
    out = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        at = data[lead].astype(np.int64)
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        one, two, three = (padded[lead + k] & 63 for k in (1, 2, 3))
        length = np.where(at < 0xE0, 2, np.where(at < 0xF0, 3, 4))
        code = np.where(
            length == 2,
            (at & 31) << 6 | one,
            np.where(length == 3, (at & 15) << 12 | one << 6 | two, (at & 7) << 18 | one << 12 | two << 6 | three),
        )
        kind = table[code]
        for k in range(4):
            there = length > k
            out[lead[there] + k] = kind[there]
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pattern's matches begin, over all documents.

    Every byte is in a match.  Runs of one class are matches, with these
    changes: a space before another run joins it; the rest of a white-space run
    is a match of its own, as is its last character where it is no plain space;
    an apostrophe that begins a match takes a contraction's suffix along.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    head = (data & 0xC0) != 0x80
    runs = np.flatnonzero(start)
    ends = np.concatenate([runs[1:], [n]])
    blank = kind[runs] == SPACE
    # white space before a visible character of the same document
    followed = blank & (ends < n) & ~edge[ends]
    stop = ends[followed]
    last = stop - 1
    for _ in range(3):
        last = np.where(head[last], last, last - 1)
    start[last] = True
    joins = data[last] == 32
    start[stop[joins]] = False
    for at in np.flatnonzero((data == 39) & start):
        after = at + 1
        for suffix in SUFFIXES:
            end = after + len(suffix)
            if end <= n and data[after:end].tobytes() == suffix and not edge[after:end].any():
                start[after] = False
                if end < n:
                    start[end] = True
                break
    return np.flatnonzero(start)


class Vocabulary:
    """Token bytes and the ranks of mergeable pairs of a ranks file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        keys, values = [], []
        for token, rank in ranks.items():
            tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs = np.array(keys, np.int64)[order]
        self.merged = np.array(values, np.int32)[order]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        length = np.array([len(t) for t in tokens], np.int64)
        self.length = length
        self.first = np.cumsum(length) - length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.whole = ranks
        one, two = np.meshgrid(self.of_byte, self.of_byte, indexing="ij")
        self.of_two_bytes = self.rank(one, two).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two do not merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(data: np.ndarray, starts: np.ndarray, length: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces of one length, a row of ``length`` each, and the number of ids in each row."""
    raw = data[starts[:, None] + np.arange(length)]
    out, size = vocab.of_byte[raw], np.full(len(starts), length)
    rank = vocab.of_two_bytes[raw[:, :-1], raw[:, 1:]]
    symbol, rank = out, np.where(rank < 0, NO_RANK, rank)
    which = np.arange(len(starts))
    for left in range(length, 1, -1):
        at = rank.argmin(axis=1)
        least = rank[np.arange(len(at)), at]
        goes = least != NO_RANK
        if not goes.all():
            done = which[~goes]
            out[done, :left], size[done] = symbol[~goes], left
            which, symbol, rank, at, least = which[goes], symbol[goes], rank[goes], at[goes], least[goes]
            if not len(which):
                return out, size
        row, place = np.arange(len(which)), np.arange(left - 1)
        # the symbol after the merged one, and its pair, close up
        symbol = np.where(place <= at[:, None], symbol[:, :-1], symbol[:, 1:])
        symbol[row, at] = least
        rank = np.where(place[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
        for pair, there in ((at - 1, at > 0), (at, at < left - 2)):
            own, pair = row[there], pair[there]
            found = vocab.rank(symbol[own, pair], symbol[own, pair + 1])
            rank[own, pair] = np.where(found < 0, NO_RANK, found)
    out[which, :1], size[which] = symbol, 1
    return out, size


def encode_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the pieces ``data[start : start + length]``, and their offsets."""
    long = np.flatnonzero(lengths > SHORT_BYTES)
    ids, at = replay(data, starts[long], lengths[long], vocab)
    parts, which, sizes = [ids], [long], [np.diff(at)]
    for length in range(1, SHORT_BYTES + 1):
        own, most = np.flatnonzero(lengths == length), ROUND_CELLS // length
        for part in (own[k : k + most] for k in range(0, len(own), most)):
            cells, size = merge_rounds(data, starts[part], length, vocab)
            parts.append(cells[np.arange(length) < size[:, None]])
            which.append(part)
            sizes.append(size)
    flat, order, size = np.concatenate(parts), np.argsort(np.concatenate(which)), np.concatenate(sizes)
    return gathered(flat, np.concatenate([[0], np.cumsum(size)]), order)


def gathered(values: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[at[k] : at[k + 1]]`` for each ``k`` of ``pick``, joined, and their offsets."""
    size = np.diff(at)[pick]
    offsets = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(int(offsets[-1])) + np.repeat(at[:-1][pick] - offsets[:-1], size)], offsets


def replay(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the pieces ``data[start : start + length]``, and their offsets."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbol = vocab.of_byte[data[np.arange(total) + np.repeat(starts - first, lengths)]]
    after = np.arange(1, total + 1)
    before = np.arange(-1, total - 1)
    inner = np.ones(total, bool)
    if len(lengths):
        before[first] = -1
        after[first + lengths - 1] = -1
        inner[first + lengths - 1] = False
    held = np.full(total, -1, np.int32)  # rank of the pair that begins here
    at = np.flatnonzero(inner)
    held[at] = vocab.rank(symbol[at], symbol[at + 1])
    alive = np.ones(total, bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(positions: np.ndarray) -> None:
        ranks = held[positions]
        some = ranks >= 0
        positions, ranks = positions[some], ranks[some]
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for group, rank in zip(np.split(positions, cut), ranks[np.concatenate([[0], cut])].tolist()):
            if rank in index:
                index[rank].append(group)
            else:
                index[rank] = [group]
                heapq.heappush(heap, rank)

    post(at)
    while heap:
        rank = heapq.heappop(heap)
        groups = index.pop(rank)
        here = np.sort(np.concatenate(groups)) if len(groups) > 1 else np.sort(groups[0])
        here = here[alive[here] & (held[here] == rank)]
        if not len(here):
            continue
        lead = np.ones(len(here), bool)
        lead[1:] = owner[here[1:]] != owner[here[:-1]]
        rest = here[~lead]
        here = here[lead]
        gone = after[here]
        symbol[here] = rank
        alive[gone] = False
        beyond = after[gone]
        after[here] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = here[linked]
        held[here] = -1
        held[here[linked]] = vocab.rank(symbol[here[linked]], symbol[beyond[linked]])
        prior = before[here]
        prior = prior[prior >= 0]
        held[prior] = vocab.rank(symbol[prior], symbol[after[prior]])
        post(np.concatenate([here[linked], prior]))
        if len(rest):
            again = rest[alive[rest] & (held[rest] == rank)]
            if len(again):
                post(again)
    count = np.bincount(owner[alive], minlength=len(lengths)) if total else np.zeros(len(lengths), np.int64)
    return symbol[alive], np.concatenate([[0], np.cumsum(count)])


def encode_corpus(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all documents in order, and the documents' offsets in them."""
    starts = piece_starts(data, offsets)
    ends = np.concatenate([starts[1:], [len(data)]])
    hashes = span_hashes(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    ids, at = encode_pieces(data, starts[first], (ends - starts)[first], vocab)
    flat, total = gathered(ids, at, which)
    return flat, total[np.searchsorted(starts, offsets)]


def decode(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The bytes of a sequence of token ids."""
    length = vocab.length[ids]
    lead = np.cumsum(length) - length
    return vocab.bytes[np.arange(int(length.sum())) + np.repeat(vocab.first[ids] - lead, length)]


def corpora(column: pa.Array, limit: int = CORPUS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents with about ``limit`` bytes of text each."""
    raw, offsets = buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for low, high, data, offsets in corpora(batch.column("text")):
                ids, at = encode_corpus(data, offsets, vocab)
                counts, sums, decoded = [], [], []
                for d in range(high - low):
                    own = ids[at[d] : at[d + 1]]
                    counts.append(len(own))
                    sums.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(decode(own, vocab).tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(counts, pa.int64()), pa.array(sums), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for low, high, data, offsets in corpora(batch.column("_text")):
                ids, at = encode_corpus(data, offsets, vocab)
                cells = [ids[at[d] : at[d + 1]].astype("<u4").tobytes() for d in range(high - low)]
                kept = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at), pa.int64()), pa.array(cells, pa.binary())], names=[str(i) for i in range(len(kept) + 2)])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            cells = batch.column(batch.num_columns - 1)
            texts = [None if c is None else decode(np.frombuffer(c, "<u4"), vocab).tobytes().decode("utf-8", "replace") for c in cells.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[str(i) for i in range(batch.num_columns)])

    return run


def _typed(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{i}` {df.schema[i].dataType.simpleString()}" for i in range(len(names)))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """Append the token count and the ids (little-endian unsigned 32-bit) to every row.

    Where ``docs`` has a column of such a name, the new one gets underscores after it.
    """
    names = docs.columns
    count_col, ids_col = free_name(docs, count_col), free_name(docs, ids_col)
    plain = docs.toDF(*[str(i) for i in range(len(names))])
    text = F.coalesce(F.col(f"`{names.index(text_col)}`"), F.lit("")).alias("_text")
    schema = _typed(plain, names) + f", `{len(names)}` long, `{len(names) + 1}` binary"
    return plain.select("*", text).mapInArrow(released(_encoded(path)), schema).toDF(*names, count_col, ids_col)


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append the text that the ids stand for; null ids give null."""
    names = rows.columns
    plain = rows.toDF(*[str(i) for i in range(len(names))])
    source = plain.select("*", F.col(f"`{names.index(ids_col)}`").alias("_ids"))
    return source.mapInArrow(_decoded(path), _typed(plain, names) + f", `{len(names)}` string").toDF(*names, text_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
