"""Token counts by heap-and-linked-list byte-pair merging, without token ids.

A piece starts as one symbol for each of its bytes, the last one marked as the
word's end.  The adjacent pairs that the vocabulary merges lie on a heap by
rank, then place; the lowest is popped, its right symbol is unlinked, and the
pairs with the two new neighbours are pushed.  An entry whose pair has changed
since is skipped.  The count is the number of initial symbols less the number
of merges.  Symbols are numbers during the merging, but no token id is looked up.

The tokenizer file names the normaliser and the rule that cuts text into
pieces; both are applied as the ``tokenizers`` library does.  No piece spans
ASCII white space and normalising does not reach over it, so a text's count is
the sum over its words.  A word is merged once for each batch and kept in a
cache of at most ``CACHED_WORDS`` words a worker, which bounds memory and does
not touch results.  Special strings of the file are one token each wherever
they stand, also inside a word.

Defined cases: a null or empty text and one of white space only have no tokens;
null texts have no bytes; repeated rows stay, each with its own count; an empty
table gives an empty one.  Only the id and the text column are read, so further
columns may have any name.  A text of any length is counted whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import chunks, span_hashes, word_spans

CACHED_WORDS = 1 << 19
LIMIT = 2048
RANK_BITS = 32
PLACE = (1 << RANK_BITS) - 1
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
# byte-level files write the bytes without a printable Latin-1 sign as the signs from U+0100 on
_UNPRINTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_SIGNS = {b: 0x100 + k for k, b in enumerate(_UNPRINTED)}


class Merges:
    """Normaliser, splitting rule and merge ranks of a ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        plain = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        if not plain or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or model["type"] != "BPE":
            raise ValueError(f"{path}: not a BPE file whose pieces are the matches of one pattern")
        if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: an option of the BPE model is not supported")
        whole = Tokenizer.from_file(path)
        self.normalise, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.end = model.get("end_of_word_suffix") or ""
        # a Latin-1 word is its own normal form but for case, so it needs no call of the library
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall if kinds == ["NFC", "Replace", "Lowercase"] else None
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[bytes, int] = {}
        # symbols are numbered by their strings; a merge maps two symbols to rank and new symbol
        number: dict[str, int] = {}
        name = lambda s: number.setdefault(s, len(number))
        self.symbol = {s: name(s) for s in model["vocab"]}
        self.pair = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pair.setdefault((name(left), name(right)), (rank, name(left + right)))

    def word_count(self, word: str) -> int:
        """Tokens of a text without white space."""
        if self.special is None:
            return self._plain_count(word)
        parts = self.special.split(word)
        return len(parts) - 1 + sum(map(self._plain_count, parts))

    def _plain_count(self, text: str) -> int:
        if not text:
            return 0
        if self.pieces and LATIN(text):
            return sum([self.piece_count(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_SIGNS)) for p in self.pieces(text.lower())])
        return sum(self.piece_count(piece) for piece, _ in self.split(self.normalise(text)))

    def piece_count(self, piece: str) -> int:
        """Initial symbols less merges of one piece."""
        symbols = [self.symbol[c] for c in piece[:-1]]
        symbols.append(self.symbol[piece[-1] + self.end])
        n = len(symbols)
        return n - merge_count(symbols, self.pair) if n > 1 else n


def merge_count(symbol: list[int], pair: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges a sequence of symbols undergoes; the list is used up."""
    n = len(symbol)
    get, push, pop = pair.get, heapq.heappush, heapq.heappop
    held = [get(p) for p in zip(symbol, symbol[1:])]  # rank and new symbol of the pair that begins here
    held.append(None)
    heap = [found[0] << RANK_BITS | i for i, found in enumerate(held) if found]
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        entry = pop(heap)
        i = entry & PLACE
        found = held[i]
        if not found or found[0] != entry >> RANK_BITS:
            continue  # the pair here has changed or is gone
        new = symbol[i] = found[1]
        merges += 1
        j = after[i]
        held[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            held[i] = found = get((new, symbol[k]))
            if found:
                push(heap, found[0] << RANK_BITS | i)
        else:
            held[i] = None
        h = before[i]
        if h >= 0:
            held[h] = found = get((symbol[h], new))
            if found:
                push(heap, found[0] << RANK_BITS | h)
    return merges


@lru_cache(maxsize=1)
def merges_of(path: str) -> Merges:
    return Merges(path)


def text_counts(data: np.ndarray, offsets: np.ndarray, merges: Merges, cache: dict[bytes, int]) -> np.ndarray:
    """Tokens of each text."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    _, lead, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    counts = np.empty(len(lead), np.int64)
    for k, (start, end) in enumerate(zip(starts[lead].tolist(), ends[lead].tolist())):
        word = raw[start:end]
        count = cache.get(word)
        if count is None:
            count = merges.word_count(word.decode("utf-8", "replace"))
            if len(cache) >= CACHED_WORDS:
                cache.clear()
            if len(word) <= 64:
                cache[word] = count
        counts[k] = count
    total = np.concatenate([[0], np.cumsum(counts[which])])
    return np.diff(total[first])


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                counts = text_counts(data, offsets, merges, merges.cache)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(offsets), pa.int64()), pa.array(counts, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; no shuffle.

    ``path`` is a ``tokenizers`` JSON file, read on the executors;
    ``over_limit`` tells whether a text has more than ``limit`` tokens.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_counted(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
