"""Phrase collocations, counted in the dictionary of a prefix-free parse.

1. A text is cut into pieces at punctuation and line ends, and a piece into
   words.  Wherever the hash of ``longest - 1`` neighbouring words is a multiple
   of ``TRIGGER``, a new chunk begins there; the chunk before it ends after
   these words, so neighbouring chunks overlap by them.  Where a chunk begins
   depends on the words alone, so equal passages give equal chunks.  The distinct
   chunks of a language with their frequencies are the dictionary; nothing after
   it looks at the texts again.
2. A phrase of up to ``longest`` words lies whole in the chunk in which it
   begins.  Phrases that begin in the overlap belong to the next chunk, so each
   is counted once, with the chunk's frequency.
3. Counts by hash come first: all words and pairs; then longer phrases of
   which both parts may be frequent.  A bitmap of the frequent hashes tells which
   phrases are then counted by their words.  Equal hashes only let a phrase
   through to that count, so all counts are exact.
4. Each candidate's cuts are joined with the counts of both parts.  Scores are
   exact decimals; the lowest one of a candidate counts.  A candidate inside a
   longer one with at least half as many occurrences is dropped.

Hash lengths and bitmap grow with the number of words, the bitmap to
``MOST_BITS`` bits (16 MB) at most; beyond about a hundred million frequent
phrases it lets more phrases through to the exact count, with equal results.

Defined cases: a null or empty text has no words; a null language is ``und``;
repeated rows count as often as they occur; an empty table gives an empty one.
Ties are settled as ``collocations`` says.  Only the language and the text
column are read, so further columns may have any name.  A text of any length is
parsed whole; a piece without a trigger is one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textops import _LOWER, MULTIPLIER, U64, buffers, chunks, mix, span_hashes, word_spans

LONGEST = 3
LEAST_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50
TRIGGER = 16
LEAST_BITS, MOST_BITS = 15, 27
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_SINGLE = np.zeros(256, bool)
_SINGLE[0x20] = True
_PLACES = mix(np.arange(11, 43, dtype=U64) * MULTIPLIER) | U64(1)


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes, which may overlap, as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], size)
    kind = pa.large_string()
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])]).cast(pa.string())


def parse(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Chunks (lower-cased words joined by one space), their text's number, and whether they end a piece."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, _BREAK | _BLANK)
    n, window = len(starts), longest - 1
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    hashes = span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts) + text
    head = np.ones(n, bool)
    head[1:] = piece[1:] != piece[:-1]
    cut = head.copy()
    if n >= window:
        span = n - window + 1
        rolled = sum(hashes[j : j + span] * _PLACES[j] for j in range(window))
        cut[:span] |= (mix(rolled) % U64(TRIGGER) == 0) & (piece[:span] == piece[window - 1 :])
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], n)
    last = np.append(head[begin[1:]], True)
    stop = np.where(last, stop, stop + window)
    # the words with one space after each
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    spaced = np.full(int(at[-1]), 0x20, np.uint8)
    lead = np.cumsum(size) - size
    flat = np.arange(int(size.sum()))
    spaced[flat + np.repeat(at[:-1] - lead, size)] = data[flat + np.repeat(starts - lead, size)]
    return _gathered(spaced, at[begin], at[stop] - 1), text[begin], last


def _parsed(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                chunk, text, last = parse(data, offsets, longest)
                lang = batch.column("lang").slice(low, high - low).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([lang, chunk, pa.array(last)], names=["lang", "chunk", "last"])

    return run


class Grams:
    """The words of a batch of dictionary chunks and the phrases that begin in them."""

    def __init__(self, batch: pa.RecordBatch, longest: int):
        raw, edges = buffers(batch.column("chunk"))
        self.data, offsets = raw[edges[0] : edges[-1]], edges - edges[0]
        self.starts, self.ends, first = word_spans(self.data, offsets, _SINGLE)
        count = np.diff(first)
        self.row = np.repeat(np.arange(len(count)), count)
        own = count - np.where(np.asarray(batch.column("last")), 0, longest - 1)
        place = np.arange(len(self.row)) - first[:-1][self.row]
        self.owned, self.left = place < own[self.row], count[self.row] - place
        langs = batch.column("lang").dictionary_encode()
        tags = [hashlib.blake2b(name.encode(), digest_size=8).digest() for name in langs.dictionary.to_pylist()]
        self.tag = np.frombuffer(b"".join(tags), U64)[np.asarray(langs.indices)][self.row]
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.times = np.asarray(batch.column("n"))[self.row]

    def hashes(self, length: int) -> np.ndarray:
        """The hash of the phrase of ``length`` words at each word; meaningless where ``fits`` is false."""
        n = len(self.words)
        total = self.tag * _PLACES[-length]
        for j in range(length):
            total[: n - j] += self.words[j:] * _PLACES[j]
        return mix(total)

    def fits(self, length: int) -> np.ndarray:
        return self.left >= length

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        return _gathered(self.data, self.starts[at], self.ends[at + length - 1])


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & U64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


def _both_parts(grams: Grams, length: int, bitmap: np.ndarray) -> np.ndarray:
    """Where a phrase fits of which the first and the last ``length - 1`` words may be frequent."""
    part = _passes(bitmap, grams.hashes(length - 1)) & grams.fits(length - 1)
    return part & np.append(part[1:], False) & grams.fits(length)


def _hashed(lengths: tuple[int, ...], longest: int, bits: int, parts: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = Grams(batch, longest)
            keys, times = [], []
            for length in lengths:
                at = grams.fits(length) if parts is None else _both_parts(grams, length, parts)
                at = np.flatnonzero(at & grams.owned)
                keys.append(grams.hashes(length)[at] & U64((1 << bits) - 1))
                times.append(grams.times[at])
            key, times = np.concatenate(keys).astype(np.int64), np.concatenate(times)
            order = np.argsort(key)
            key, times = key[order], times[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            total = np.add.reduceat(times, head) if len(head) else times
            yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(total)], names=["key", "n"])

    return run


def _named(longest: int, bitmaps: list[np.ndarray]):
    """Phrases whose hash is in the bitmap of their length, with their counts in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = Grams(batch, longest)
            for length in range(1, longest + 1):
                bitmap = bitmaps[max(0, length - 2)]
                at = np.flatnonzero(grams.fits(length) & grams.owned & _passes(bitmap, grams.hashes(length)))
                table = pa.table([batch.column("lang").take(pa.array(grams.row[at])), grams.phrases(at, length), pa.array(grams.times[at])], names=["lang", "phrase", "n"])
                summed = table.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
                cells = [summed.column(c).combine_chunks() for c in ("lang", "phrase", "n_sum")]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(np.full(len(summed), length, np.int32))], names=["lang", "phrase", "n", "words"])

    return run


def chunk_dictionary(docs: DataFrame, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, chunk, last, n``: the distinct chunks of each language and their frequencies, written."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parsed = texts.where("text is not null").mapInArrow(_parsed(longest), "lang string, chunk string, last boolean")
    return materialize(parsed.groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("n")), "phrase-chunks")


def _bitmap(hashed: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of the keys that occur ``least`` times; built on the executors in parts of 4 KB."""
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # the functions count from one
    frequent = hashed.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(slot.alias("slot"))
    part = F.bitmap_bucket_number("slot").alias("part")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in frequent.groupBy(part).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("cell")).collect():
        out[4096 * (row.part - 1) : 4096 * row.part] = np.frombuffer(row.cell, np.uint8)
    return out


def phrase_counts(dictionary: DataFrame, words: int, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of up to ``longest`` words with ``n >= least``, written."""
    keys = min(62, max(LEAST_BITS, int(words).bit_length() + 5))
    bits = min(MOST_BITS, max(LEAST_BITS, keys - 7))
    bitmaps = []
    for lengths in [(1, 2), *((m,) for m in range(3, longest + 1))]:
        hashed = dictionary.mapInArrow(_hashed(lengths, longest, keys, bitmaps[-1] if bitmaps else None), "key long, n long")
        bitmaps.append(_bitmap(hashed, least, bits))
    named = dictionary.mapInArrow(_named(longest, bitmaps), "lang string, phrase string, n long, words int")
    counts = named.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialize(counts, "phrase-counts")


def word_totals(dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang, n``: all word occurrences of each language; an overlap's words belong to the next chunk."""
    own = F.length("chunk") - F.length(F.translate("chunk", " ", "")) + 1 - F.when(F.col("last"), 0).otherwise(longest - 1)
    return dictionary.groupBy("lang").agg(F.sum(own * F.col("n")).alias("n"))


def scored_candidates(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of all phrases of two words or more, by their lowest cut.

    ``score`` is ``floor(1000000 * a * a / (l * r))``, from decimals of 38 digits.
    """
    cuts = counts.where("words > 1").select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    left = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("left", left).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    part = counts.select("lang", "phrase", "n")
    lefts = part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = "(1000000BD * cast(a as decimal(14, 0)) * cast(a as decimal(14, 0))) div (cast(l as decimal(14, 0)) * cast(r as decimal(14, 0)))"
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", F.expr(score))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def without_parts(candidates: DataFrame, longest: int = LONGEST, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Candidates that lie in no longer one with ``100 * f(longer) >= percent * a``."""
    spans = [(m, i) for m in range(2, longest) for i in range(longest - m + 1)]
    if not spans:
        return candidates
    word = F.split("phrase", " ")
    parts = F.array(*[F.when(F.lit(i + m) <= F.col("words"), F.when(F.lit(m) < F.col("words"), F.array_join(F.slice(word, i + 1, m), " "))) for m, i in spans])
    longer = candidates.where("words > 2").select("lang", "a", F.explode(parts).alias("phrase")).where("phrase is not null")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    joined = candidates.join(longer, ["lang", "phrase"], "left")
    return joined.where(f"outer is null or 100 * outer < {percent} * a").drop("outer")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST_COUNT,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of each language.

    Best is the highest score, then the highest ``a``, then the least phrase in
    UTF-8 byte order.  The best of ``SALTS`` parts of each language come first,
    so that no task sorts all candidates of one language.
    """
    dictionary = chunk_dictionary(docs, longest, lang_col, text_col)
    totals = word_totals(dictionary, longest)
    words = totals.agg(F.sum("n")).first()[0] or 0
    candidates = without_parts(scored_candidates(phrase_counts(dictionary, words, longest, least)), longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# the fixed values are those of this module's parameters
COLLOCATIONS_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
    FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT d, lang, generate_subscripts(ps, 1) AS p, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM texts),
words AS (SELECT d, p, lang, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM pieces),
following AS (
    SELECT lang, w, lead(w) OVER piece AS w2, lead(w, 2) OVER piece AS w3
    FROM words WINDOW piece AS (PARTITION BY d, p ORDER BY i)),
f AS (
    SELECT lang, 1 AS m, w AS phrase, count(*) AS n FROM following GROUP BY ALL
    UNION ALL SELECT lang, 2, w || ' ' || w2 AS phrase, count(*) FROM following WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM following WHERE w3 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
cuts AS (
    SELECT lang, m, phrase, n AS a, k,
           array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
    FROM f, (VALUES (1), (2)) AS places(k) WHERE m > 1 AND k < m AND n >= 10),
scored AS (
    SELECT c.*, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT s.lang, s.phrase FROM lowest s JOIN (
        SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
        FROM lowest WHERE m = 3) t ON t.lang = s.lang AND t.part = s.phrase
    WHERE 100 * t.a >= 50 * s.a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside))
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
