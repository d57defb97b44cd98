"""Quality and toxicity with hierarchical empirical Bayes.

1. Document evidence: two logistic models (acceptable quality, toxic) over
   hashed words and word beginnings whose share differs clearly between the
   classes, and a few shape features, trained in numpy on a sample of about ``TRAIN_DOCUMENTS`` labelled documents chosen by a hash of
   their id (a parameter; all of them where there are fewer).
2. Host and path posteriors over all documents, by grouped aggregates: a host's
   rate of bad documents is a beta posterior whose prior is the global rate, a
   path's is one whose prior is its host's posterior.  The priors' strengths
   come from the spread of the group rates (method of moments), so sparse sites
   shrink to the global rate and large ones stand on their own evidence.
3. A document's log odds are its evidence plus ``SITE_WEIGHT`` times the
   difference of its path's and the global log odds.

``keep`` is false where either the quality or the toxicity posterior says bad.
Where a table has no path column, the path is host and language.  A null host
or path is a group of its own; a null or blank text has no evidence but its
site's and is kept unless that is bad.  Only aggregates are shuffled by host,
with partial sums first, so a hot host costs nothing; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import free_name, row_key
from .textops import U64, chunks, mix, span_hashes, word_spans
from .workers import give_back, released

BUCKETS = 1 << 17
SHAPES = 9
TRAIN_DOCUMENTS = 8000
EPOCHS = 10
LEAST_Z, LEAST_SEEN = 6.0, 8
DECAY = 1e-3
SITE_WEIGHT = 0.25
MOST_STRENGTH, LEAST_STRENGTH = 1000.0, 2.0
BEGINNINGS = (4, 5)

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    weights: np.ndarray  # two columns: bad quality, toxic
    bias: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of all documents in order, their offsets, and the shape features.

    A document's ids are distinct.
    """
    lower = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, _NOT_LETTER)
    words = span_hashes(lower, starts, ends)
    heads = [mix(span_hashes(lower, starts, np.minimum(ends, starts + k)) + U64(k)) for k in BEGINNINGS]
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    key = np.unique(np.concatenate([owner * BUCKETS + ((h >> U64(1)) % U64(BUCKETS)).astype(np.int64) for h in (words, *heads)]))
    at = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
    size = np.maximum(1, np.diff(offsets)).astype(float)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    count = np.maximum(1, np.diff(first)).astype(float)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    letters = ~_NOT_LETTER[data]
    upper = (data >= 65) & (data <= 90)
    spaces = (data == 32) | (data == 10)
    digits = (data >= 48) & (data <= 57)
    line_starts, line_ends, line_first = word_spans(data, offsets, _LINE_END)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    n_lines = np.diff(line_first)
    lines = span_hashes(lower, line_starts, line_ends)
    n_distinct_lines = np.bincount(np.unique(line_owner * (1 << 24) + (lines >> U64(40)).astype(np.int64)) >> 24, minlength=n)
    # the count of a document's commonest word
    pair, times = np.unique(owner * (1 << 24) + (words >> U64(40)).astype(np.int64), return_counts=True)
    longest = np.zeros(n)
    np.maximum.at(longest, pair >> 24, times)
    shape = np.stack(
        [
            10 * sums(~letters & ~spaces & ~digits & (data != 44) & (data != 46)) / size,
            5 * sums(digits) / size,
            4 * longest / count,
            (n_lines - n_distinct_lines) / np.maximum(1, n_lines),
            sums(upper) / np.maximum(1, sums(letters)),
            np.bincount(pair >> 24, minlength=n) / count,
            4 * np.bincount(owner[same], minlength=n) / count,
            np.log1p(count) / 10,
            4 * sums(data == 124) / count,
        ],
        1,
    )
    return (key % BUCKETS).astype(np.int64), at, np.minimum(shape, 4.0)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            ids, at, shape = features(data, offsets)
            cells = [ids[at[d] : at[d + 1]].astype("<u4").tobytes() for d in range(high - low)]
            kept = [batch.column(c).slice(low, high - low) for c in ("key", "bad", "toxic")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(cells, pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary())], names=["key", "bad", "toxic", "ids", "shape"]
            )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def clear_features(rows: list[tuple], truth: np.ndarray) -> np.ndarray:
    """Features whose share of documents differs clearly between the classes, for each target."""
    out = np.zeros((BUCKETS, truth.shape[1]), bool)
    if not rows:
        return out
    flat = np.concatenate([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    seen = np.bincount(flat, minlength=BUCKETS)
    for k in range(truth.shape[1]):
        ones = truth[:, k].sum()
        if not 0 < ones < len(rows):
            continue
        inside = np.bincount(flat, weights=truth[owner, k], minlength=BUCKETS)
        share = seen / len(rows)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / ones + 1 / (len(rows) - ones)))
        z = (inside / ones - (seen - inside) / (len(rows) - ones)) / error
        out[:, k] = (np.abs(z) >= LEAST_Z) & (seen >= LEAST_SEEN)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, float, float]], seed: int = 1) -> Model:
    """Logistic models of (feature ids, shape, bad, toxic), by stochastic gradient descent with AdaGrad."""
    total = BUCKETS + SHAPES
    weights, bias = np.zeros((total, 2)), np.zeros(2)
    spread, spread_bias = np.full((total, 2), 1e-2), np.full(2, 1e-2)
    truth = np.array([r[2:4] for r in rows], float).reshape(-1, 2)
    clear = clear_features(rows, truth)
    either = clear.any(1)
    if len(rows):
        rate = (truth.sum(0) + 1) / (len(rows) + 2)
        bias = np.log(rate / (1 - rate))
    rng = np.random.default_rng(seed)
    shapes = np.arange(BUCKETS, total)
    kept = [r[0][either[r[0]]] for r in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, shape = kept[i], rows[i][1]
            error = _sigmoid(weights[ids].sum(0) + shape @ weights[shapes] + bias) - truth[i]
            for at, step in ((ids, error * clear[ids] + DECAY * weights[ids]), (shapes, shape[:, None] * error)):
                grown = spread[at] + step * step
                spread[at] = grown
                weights[at] -= 0.3 * step / np.sqrt(grown)
            spread_bias += error * error
            bias -= 0.1 * error / np.sqrt(spread_bias)
    return Model(weights, bias)


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.weights[:BUCKETS]
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                n = high - low
                ids, at, shape = features(data, offsets)
                owner = np.repeat(np.arange(n), np.diff(at))
                sums = np.stack([np.bincount(owner, weights=table[ids, k], minlength=n) for k in (0, 1)], 1)
                logit = sums + shape @ model.weights[BUCKETS:] + model.bias
                _, _, first = word_spans(data, offsets)
                logit[np.diff(first) == 0] = np.nan  # a blank text is no evidence
                cells = [pa.array(logit[:, k], from_pandas=True) for k in (0, 1)]
                kept = [batch.column(c).slice(low, n) for c in ("key", "doc_id", "host", "path")]
                yield pa.RecordBatch.from_arrays([*kept, *cells], names=["key", "doc_id", "host", "path", "bad", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, documents: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on a hash sample of about ``documents`` labelled documents."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    cut = int(min(1.0, documents / max(1, n)) * (1 << 31))
    chosen = known.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) < cut)
    marks = chosen.select(
        F.col("doc_id").alias("_id"),
        (F.coalesce("quality", F.lit(1)) == 0).cast("double").alias("bad"),
        (F.coalesce("toxic", F.lit(0)) == 1).cast("double").alias("toxic"),
    )
    # about `documents` rows: their number is the parameter's bound, whatever the input
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    found = rows.where("text is not null").join(F.broadcast(marks), "_id").select("key", "text", "bad", "toxic")
    table = found.mapInArrow(released(_sample), "key long, bad double, toxic double, ids binary, shape binary").toArrow()
    listed = sorted(table.to_pylist(), key=lambda r: (r["key"], r["ids"]))
    del table
    rows = [(np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["shape"]), r["bad"], r["toxic"]) for r in listed]
    del listed
    return fit(rows)


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _rate(logit: str) -> Column:
    return 1 / (1 + F.exp(-F.col(logit)))


def _strength(groups: DataFrame, kind: str, mean: float) -> float:
    """Strength of the beta prior whose spread explains that of the groups' rates."""
    rate = F.col(f"s_{kind}") / F.col("n")
    n, rows, spread = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.pow(rate - mean, 2))).first()
    if not rows or n < 2 or not 0 < mean < 1:
        return MOST_STRENGTH
    noise = mean * (1 - mean)
    between = max(1e-9, (spread - (n - 1) * noise) / rows)
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, noise / between - 1)))


def _posteriors(scored: DataFrame) -> DataFrame:
    """``host, path, site_bad, site_toxic``: log odds of a path against the global ones."""
    with_text = scored.where("bad is not null")
    kinds = ("bad", "toxic")
    sums = [F.sum(_rate(k)).alias(f"s_{k}") for k in kinds]
    paths = materialize(with_text.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in kinds])
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in kinds]).first()
    n = total["n"] or 0
    mean = {k: ((total[f"s_{k}"] or 0.0) + 1) / (n + 2) for k in kinds}
    for_hosts = {k: _strength(hosts, k, mean[k]) for k in kinds}
    for_paths = {k: _strength(paths, k, mean[k]) for k in kinds}
    host = hosts.select(F.col("host").alias("_h"), *[((F.col(f"s_{k}") + for_hosts[k] * mean[k]) / (F.col("n") + for_hosts[k])).alias(f"h_{k}") for k in kinds])
    joined = paths.join(host, F.col("host").eqNullSafe(F.col("_h")))
    path = [(F.col(f"s_{k}") + for_paths[k] * F.col(f"h_{k}")) / (F.col("n") + for_paths[k]) for k in kinds]
    site = [(_log_odds(p) - _log_odds(F.lit(mean[k]))).alias(f"site_{k}") for k, p in zip(kinds, path)]
    return joined.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *site)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str | None = None
) -> DataFrame:
    """``key, doc_id, host, path, bad, toxic, p_bad, p_toxic, keep`` of every row.

    ``bad`` and ``toxic`` are the documents' own log odds; ``key`` is ``row_key``.
    """
    model = train(docs, labels, id_col, text_col)
    give_back()  # the driver's part of the sample
    host = F.col(host_col).cast("string")
    path = F.col(path_col).cast("string") if path_col else F.concat_ws("/", host, "lang") if "lang" in docs.columns else host
    rows = docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text")
    )
    schema = "key long, doc_id long, host string, path string, bad double, toxic double"
    scored = materialize(rows.mapInArrow(released(_evidence(model)), schema), "quality-scored")
    sites = _posteriors(scored)
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    odds = lambda k: F.coalesce(k, F.lit(float(model.bias[0 if k == "bad" else 1]))) + SITE_WEIGHT * F.coalesce(f"site_{k}", F.lit(0.0))
    out = joined.select("key", "doc_id", "host", "path", "bad", "toxic", (1 / (1 + F.exp(-odds("bad")))).alias("p_bad"), (1 / (1 + F.exp(-odds("toxic")))).alias("p_toxic"))
    return out.withColumn("keep", (F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5))


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    rejected = classify(docs, labels, id_col, text_col, host_col).where("not keep").select("key").distinct()
    key = free_name(docs, "_key")
    return docs.withColumn(key, row_key(id_col, text_col)).join(rejected.withColumnRenamed("key", key), key, "left_anti").drop(key)
