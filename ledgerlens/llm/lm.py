"""Scoring with a deleted-interpolation bigram model.

``P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1)``: maximum
likelihood estimates of bigrams and words and a uniform part, with weights for
each bucket of the context's frequency ``c(v)`` (its binary logarithm).  The
weights are learned by expectation-maximisation on held-out counts: a seventh
of the training documents, of which bigrams and words are counted in the other
training documents only.  The final counts are those of all training documents.

Counts cover all documents and are exchanged by block (see ``blocks``): a block
sends its distinct words and bigrams with their counts, packed by bucket; each
bucket adds up and answers every block that asked, for a bigram only where the
block does not know the total already.  Then each block's texts are scored with
its answers.  No vocabulary is ever broadcast or gathered.  The held-out counts
for the weights come back as a histogram of fixed size.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end for
each document; null texts count as empty.  A null id counts as training.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .blocks import by_block, packed_texts, unpack_texts, with_blocks
from .langid import id_remainder
from .textops import U64, chunks, mix, word_hashes

TRAIN, TUNE, HELD_OUT = 0, 1, 2  # kinds of block
WORD, PAIR, TOTALS = 0, 1, 2  # kinds of request
END = U64(0x5851F42D4C957F2D)
BEGIN = U64(0x14057B7EF767814F)
BUCKET_BYTES = 8 << 20
NAME_BITS = {WORD: 48, PAIR: 40}
CONTEXTS = 24
STEPS = 96  # ratios of two estimates, in half powers of two; 0 stands for none
_ANSWERS = "block long, kind int, bucket int, payload binary"
_ANSWERS_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with ends, the token before each (or ``BEGIN``), and document offsets."""
    words, counts = [], []
    for _, _, data, offsets in chunks(text):
        own, first = word_hashes(data, offsets)
        words.append(own)
        counts.append(np.diff(first))
    flat = np.concatenate(words) if words else np.zeros(0, U64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.empty(len(flat) + len(count), U64)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = flat
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = BEGIN
    return out, before, at


def pair_keys(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9E3779B97F4A7C15) + own)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of a key are its bucket."""
    return (keys >> U64(64 - bits)).astype(np.int64)


def _within(keys: np.ndarray, bits: int, kind: int) -> np.ndarray:
    """The next bits, which name a key inside its bucket, in the keys' order.

    48 for words.  40 for bigrams: buckets grow in number with the data, so
    about one bigram in a million shares its name with another, at any size.
    """
    return (keys << U64(bits)) >> U64(64 - NAME_BITS[kind])


def _pack(values: np.ndarray) -> bytes:
    """48-bit numbers as six planes of bytes; planes of zeros compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpack(raw: bytes, n: int, offset: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8, count=6 * n, offset=offset).reshape(6, n).T
    return out.view("<u8").reshape(n)


def _pack_ascending(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=U64(0)))


def _unpack_ascending(raw: bytes, n: int, offset: int = 0) -> np.ndarray:
    return np.cumsum(_unpack(raw, n, offset), dtype=U64)


def _pack_counts(values: np.ndarray, counts: np.ndarray) -> bytes:
    return struct.pack("<I", len(values)) + _pack_ascending(values) + _pack(counts - 1)


def _unpack_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", raw)
    return _unpack_ascending(raw, n, 4), _unpack(raw, n, 4 + 6 * n).astype(np.int64) + 1


def _requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part in by_block(batch):
                own, before, _ = tokens(part.column("text"))
                rows = []
                for kind, keys in ((WORD, own), (PAIR, pair_keys(before, own))):
                    keys, counts = np.unique(keys, return_counts=True)
                    where, names = _bucket(keys, bits), _within(keys, bits, kind)
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]])
                    rows += [(block, kind, int(where[a]), _pack_counts(names[a:b], counts[a:b])) for a, b in zip(cut[:-1], cut[1:]) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ANSWERS_ARROW)], schema=_ANSWERS_ARROW)

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of a bucket's keys for each block that asked for them.

    An answer holds keys, counts in all training documents and counts in the
    training documents outside the tuning part.
    """
    bucket, rows = key[0].as_py(), []
    blocks, kinds, cells = (table.column(c).to_pylist() for c in ("block", "kind", "payload"))
    for kind in (WORD, PAIR):
        mine = [i for i, k in enumerate(kinds) if k == kind]
        if not mine:
            continue
        parts = [_unpack_counts(cells[i]) for i in mine]
        names, place = np.unique(np.array([blocks[i] for i in mine]), return_inverse=True)
        keys = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        owner = np.repeat(place, [len(p[0]) for p in parts])
        role = (names & 3)[owner]
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=np.where(role == HELD_OUT, 0, counts)).astype(np.int64)
        outside = np.bincount(which, weights=np.where(role == TRAIN, counts, 0)).astype(np.int64)
        if kind == WORD:
            sums = np.array([total.sum(), (total > 0).sum(), outside.sum(), (outside > 0).sum()], "<i8")
            rows.append((0, TOTALS, bucket, sums.tobytes()))
        own = np.where(role == HELD_OUT, 0, counts)
        known = (total[which] == own) & (kind == PAIR) & ((role != TUNE) | (outside[which] == 0))
        known |= (total[which] == 0) & (outside[which] == 0)
        ask = np.flatnonzero(~known)
        ask = ask[np.argsort(owner[ask], kind="stable")]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(owner[ask])) + 1, [len(ask)]])
        for a, b in zip(cut[:-1], cut[1:]):
            if b > a:
                at = ask[a:b]
                at = at[np.unique(keys[at], return_index=True)[1]]  # a block may have asked twice
                answer = struct.pack("<I", len(at)) + _pack_ascending(keys[at]) + _pack(total[which[at]])
                block = int(names[owner[at[0]]])
                if block & 3 == TUNE:
                    answer += _pack(outside[which[at]])
                rows.append((block, kind, bucket, answer))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ANSWERS_ARROW)], schema=_ANSWERS_ARROW)


class Counts:
    """A block's distinct keys of one kind and their totals."""

    def __init__(self, keys: np.ndarray, bits: int, answers: list[tuple[int, bytes]], outside: bool, start: np.ndarray | None):
        self.keys = np.unique(keys) if start is None else keys
        self.totals = np.zeros(len(self.keys), np.int64) if start is None else start
        first = np.searchsorted(_bucket(self.keys, bits), np.arange((1 << bits) + 1))
        names = _within(self.keys, bits, WORD if start is None else PAIR)
        for bucket, raw in answers:
            (n,) = struct.unpack_from("<I", raw)
            asked = _unpack_ascending(raw, n, 4)
            counts = _unpack(raw, n, 4 + (12 if outside else 6) * n)
            a, b = first[bucket], first[bucket + 1]
            # every asked name is one of the block's; keys of one name share a total
            low, high = (np.searchsorted(names[a:b], asked, side) for side in ("left", "right"))
            self.totals[a + low] = counts
            for i in np.flatnonzero(high - low > 1):
                self.totals[a + low[i] : a + high[i]] = counts[i]

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.totals[at], 0)


def _estimates(block: int, texts: pa.Table, answers: pa.Table, bits: int, totals: dict, outside: bool):
    """Ids, offsets, word counts, context counts and the three estimates of each token."""
    own, before, at = tokens(texts.column("text"))
    kinds, places, cells = (answers.column(c).to_pylist() for c in ("kind", "bucket", "payload"))
    told = {k: [(b, c) for i, b, c in zip(kinds, places, cells) if i == k] for k in (WORD, PAIR)}
    words = Counts(own, bits, told[WORD], outside, None)
    pairs = pair_keys(before, own)
    names, local = np.unique(pairs, return_counts=True)
    knows = not outside and block & 3 != HELD_OUT
    bigrams = Counts(names, bits, told[PAIR], outside, local if knows else np.zeros(len(names), np.int64))
    side = "outside" if outside else "all"
    count = words.of(own)
    context = np.where(before == BEGIN, totals[f"documents_{side}"], words.of(before))
    both = bigrams.of(pairs)
    p2 = np.divide(both, context, out=np.zeros(len(own)), where=context > 0)
    p1 = count / max(1, totals[f"tokens_{side}"])
    p0 = 1.0 / (totals[f"types_{side}"] + 1)
    return at, count, context, p2, p1, p0


def context_bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXTS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)


def _ratio_step(p: np.ndarray, p0: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        step = np.rint(2 * np.log2(p / p0)) + 24
    return np.where(p > 0, np.clip(step, 1, STEPS - 1), 0).astype(np.int64)


def _tuning_cells(bits: int, totals: dict):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cells = left.column("texts").to_pylist()
        if not cells:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        _, _, context, p2, p1, p0 = _estimates(key[0].as_py(), unpack_texts(cells), right, bits, totals, True)
        cell = (context_bucket(context) * STEPS + _ratio_step(p2, p0)) * STEPS + _ratio_step(p1, p0)
        found, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(cells: dict[int, int], rounds: int = 60) -> np.ndarray:
    """Weights of (bigram, word, uniform) for each context bucket, by expectation-maximisation."""
    out = np.tile(np.array([0.4, 0.5, 0.1]), (CONTEXTS, 1))
    out[0] = (0.0, 0.8, 0.2)  # an unseen context has no bigrams
    value = np.where(np.arange(STEPS) == 0, 0.0, 2.0 ** ((np.arange(STEPS) - 24) / 2))
    keys = np.array(sorted(cells), np.int64)
    counts = np.array([cells[int(k)] for k in keys], float)
    where = keys // (STEPS * STEPS)
    parts = np.stack([value[keys // STEPS % STEPS], value[keys % STEPS], np.ones(len(keys))], 1)
    for b in np.unique(where):
        mine, weight = parts[where == b], counts[where == b][:, None]
        for _ in range(rounds):
            share = mine * out[b]
            share = share / share.sum(1, keepdims=True)
            out[b] = (share * weight).sum(0) / weight.sum()
        # no estimate is ruled out for good
        floor = np.array([0.0 if b == 0 else 1e-4, 1e-4, 1e-4])
        out[b] = np.maximum(out[b], floor) / np.maximum(out[b], floor).sum()
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(bits: int, totals: dict, weights: np.ndarray):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, cells = key[0].as_py(), left.column("texts").to_pylist()
        texts = unpack_texts(cells) if cells else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        n = texts.num_rows
        if n:
            at, count, context, p2, p1, p0 = _estimates(block, texts, right, bits, totals, False)
            w = weights[context_bucket(context)]
            logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((count + 1.0) / (totals["tokens_all"] + totals["types_all"] + 1.0))
            sums = [np.add.reduceat(x, at[:-1]) for x in (count > 0, base, logs)]
        else:
            at, sums = np.zeros(1, np.int64), [np.zeros(0)] * 3
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(np.full(n, block & 3 == HELD_OUT)),
                "n_tokens": pa.array(np.diff(at), pa.int64()),
                "n_known": pa.array(sums[0].astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(n, totals["tokens_all"]), pa.int64()),
                "base_score": pa.array(sums[1], pa.float64()),
                "score": pa.array(sums[2], pa.float64()),
            }
        )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Documents whose crc32(id as text) modulo 7 is 2 are held out; remainder 3
    is the tuning part of the training documents.
    """
    spark = docs.sparkSession
    rest = id_remainder(id_col, 7)
    kind = F.when(rest == 2, HELD_OUT).when(rest == 3, TUNE).otherwise(TRAIN)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    texts = with_blocks(docs, columns, kind)
    shape = texts.groupBy((F.col("block").bitwiseAND(F.lit(3))).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    documents = {r["kind"]: r["n"] for r in shape}
    buckets = max(2, shuffle_partitions(spark), sum(r["size"] or 0 for r in shape) // BUCKET_BYTES)
    bits = int(buckets - 1).bit_length()
    asked = texts.mapInArrow(_requests(bits), _ANSWERS)
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer, _ANSWERS), "lm-answers")
    sums = np.zeros(4, np.int64)
    for row in answers.where(f"kind = {TOTALS}").select("payload").collect():  # one row for each bucket
        sums += np.frombuffer(row.payload, "<i8")
    totals = dict(zip(("tokens_all", "types_all", "tokens_outside", "types_outside"), map(int, sums)))
    totals["documents_outside"] = documents.get(TRAIN, 0)
    totals["documents_all"] = documents.get(TRAIN, 0) + documents.get(TUNE, 0)
    packed = texts.mapInArrow(packed_texts, "block long, texts binary")
    told = answers.where(f"kind <> {TOTALS}")
    tune = (F.col("block").bitwiseAND(F.lit(3))) == TUNE
    tuned = texts.where(tune).mapInArrow(packed_texts, "block long, texts binary").groupBy("block").cogroup(told.where(tune).groupBy("block"))
    cells = tuned.applyInArrow(_tuning_cells(bits, totals), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights({r.cell: r.n for r in cells})
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(bits, totals, weights), _SCORES)
