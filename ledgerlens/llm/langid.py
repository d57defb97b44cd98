"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 3- and 4-grams of the text with A-Z lower-cased and all
bytes but letters turned into spaces; each is hashed into one of ``BUCKETS``
embeddings.  A text is the average of its subwords' embeddings; a linear layer
and a softmax give the languages.  Both layers are trained by stochastic
gradient descent in numpy, on the driver, over a sample of about
``TRAIN_DOCUMENTS`` documents chosen by a hash of their id (a parameter; fewer
where there are fewer).  A fifth of the sample sets the temperature that
calibrates the probabilities, and the score below which a prediction is
rejected so that the others are right at ``PRECISION``.

Prediction needs no shuffle: embeddings times weights is one small table.  Whole
texts are read.  A text that is null or has no letter gives ``und`` with score 0,
as does every text when nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, _byte_classes
from .textops import chunks

BUCKETS = 1 << 16
DIMENSIONS = 16
TRAIN_DOCUMENTS = 2000
EPOCHS = 8
RATE = 0.4
PRECISION = 0.99
UNKNOWN = "und"

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each subword bucket
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram and of the 4-gram that begin at each byte."""
    x = np.concatenate([_PLAIN[data], np.full(3, 32, np.uint8)]).astype(np.uint32)
    n = len(data)
    three = (x[:n] * np.uint32(0x01000193)) ^ (x[1 : n + 1] * np.uint32(0x85EBCA6B)) ^ (x[2 : n + 2] * np.uint32(0xC2B2AE35))
    four = (three * np.uint32(5)) ^ (x[3 : n + 3] * np.uint32(0x27D4EB2F)) ^ np.uint32(0x9E3779B9)
    fold = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    return fold(three), fold(four)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            ids, counts = [], []
            for d in range(high - low):
                own = data[offsets[d] : offsets[d + 1]]
                found, times = np.unique(np.concatenate(subwords(own)), return_counts=True) if len(own) else (np.zeros(0), np.zeros(0))
                ids.append(found.astype("<u2").tobytes())
                counts.append(times.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(low, high - low), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"]
            )


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model | None:
    """Train on (language, subword buckets, weights that sum to 1)."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    label = np.array([languages.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    train = order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, total = 0, EPOCHS * max(1, len(train))
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            _, ids, share = rows[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ embed[ids]
            error = _softmax(hidden @ weights + bias)
            error[label[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # the average spreads its gradient over the subwords it holds
            embed[ids] -= rate * len(ids) * share[:, None] * back[None, :] * 0.1
    table = (embed @ weights).astype(np.float32)
    logits = np.array([r[2] @ table[r[1]] + bias for r in (rows[i] for i in held)]) if len(held) else np.zeros((0, len(languages)))
    temperature, cut = 1.0, 0.0
    if len(held):
        truth = label[held]
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 20, 80), key=loss))
        sure = _softmax(logits / temperature)
        best, right = sure.max(1), sure.argmax(1) == truth
        by = np.argsort(-best, kind="stable")
        precise = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= PRECISION
        cut = float(best[by][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(languages, table, bias, temperature, cut)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                n = high - low
                langs, scores, sure = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                letters = np.concatenate([[0], np.cumsum(_byte_classes(data) == LETTER)])
                some = np.flatnonzero(letters[offsets[1:]] > letters[offsets[:-1]])
                if model is not None and len(some):
                    three, four = subwords(data)
                    logits = model.table[three] + model.table[four]
                    # grams that reach into the next document are its first bytes' only by chance: cut them off
                    for back in (1, 2, 3):
                        at = offsets[1:] - back
                        at = at[at >= offsets[:-1]]
                        logits[at] -= model.table[four[at]]
                        if back < 3:
                            logits[at] -= model.table[three[at]]
                    size = np.diff(offsets)
                    # every text that is not empty ends a sum, with or without letters
                    full = np.flatnonzero(size)
                    total = np.add.reduceat(logits, offsets[:-1][full], axis=0, dtype=np.float64)[np.searchsorted(full, some)]
                    size = size[some]
                    share = _softmax((total / np.maximum(1, 2 * size - 5)[:, None] + model.bias) / model.temperature)
                    best = share.argmax(1)
                    scores[some] = share.max(1)
                    sure[some] = share.max(1) >= model.reject_below
                    for d, k in zip(some, best):
                        langs[d] = model.languages[k]
                kept = [batch.column(c).slice(low, n) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(scores), pa.array(sure)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model | None:
    """Fit on ``docs (doc_id, text, lang)``: a hash sample of about ``documents`` rows."""
    usable = docs.where("lang is not null and text is not null")
    n = usable.count()
    if not n:
        return None
    cut = int(min(1.0, documents / n) * (1 << 31))
    sample = usable.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) < cut).select("text", "lang")
    found = sample.mapInArrow(_features, "lang string, ids binary, counts binary").toArrow().to_pylist()
    rows = []
    for r in sorted(found, key=lambda r: (r["lang"], r["ids"])):
        times = np.frombuffer(r["counts"], "<u4").astype(np.float32)
        rows.append((r["lang"], np.frombuffer(r["ids"], "<u2").astype(np.int64), times / max(1.0, float(times.sum()))))
    return fit(rows)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every document.

    Rows with remainder 1 of crc32(id as text) modulo 3 are held out of training.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
        F.coalesce(id_remainder(id_col, 3) == 1, F.lit(False)).alias("held_out"),
    )
    model = train(rows.where("not held_out"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model), schema)
