"""I-Match fingerprints: terms of an inverse-document-frequency band, hashed by lexicon subset.

1. Terms are the lower-cased runs of letters and digits.  Their document
   frequency is counted over all documents in ``TERM_BUCKETS`` hash buckets, so
   the lexicon is a bitmap of fixed size at any vocabulary.
2. The lexicon keeps buckets in at least ``MIN_DOCUMENTS`` documents and at most
   the share ``MAX_SHARE`` of them.
3. The lexicon is dealt at random into ``SUBSETS`` subsets, each with nested
   thinner versions: level ``l`` keeps a term with probability ``2**-l``.  A
   document's part of a subset is taken at the thinnest level that it still
   meets, so a long document is not one fragile hash.  Its distinct terms there
   are sorted and hashed.
4. The fingerprint joins the subsets' hashes in subset order.  Likeness of two
   fingerprints is the share of equal hashes among the subsets that either
   document meets; with none, it is 1 if both have none, else 0.

A document none of whose terms is in the band uses all its terms.  Null texts
count as empty; they and texts without terms have the empty fingerprint.  Equal
texts have equal fingerprints.  All of it is DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

TERM_BUCKETS = 1 << 20
MIN_DOCUMENTS = 2
MAX_SHARE = 0.02
SUBSETS = 32
ROWS_A_BUCKET = 1 << 16
QUANTILES = 256
BROADCAST_ROWS = 1 << 20
_LAST = -(1 << 63)

# the distinct terms of a text, hashed; the low bits are the term's bucket
_HASHES = """transform(
    array_remove(array_distinct(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+')), ''), t -> xxhash64(t))"""

# subset (5 bits), depth of its thinnest version first (25 bits), rest of the hash (33 bits)
_PACKED = """sort_array(transform({terms}, h ->
    shiftleft(h & 31, 58)
    + shiftleft(16777216L - ((shiftright(h, 5) & 8388607 | 8388608) & -(shiftright(h, 5) & 8388607 | 8388608)), 33)
    + shiftrightunsigned(h, 31)))"""

# one signature for each subset: a running hash of the sorted terms of its thinnest version
_SIGNATURES = """aggregate({packed},
    named_struct('group', -1L, 'hash', 0L, 'done', cast(array() as array<bigint>)),
    (s, v) -> if(shiftright(v, 33) = s.group,
        named_struct('group', s.group, 'hash', xxhash64(s.hash, v), 'done', s.done),
        if(shiftright(v, 58) = shiftright(s.group, 25) and s.group >= 0, s,
            named_struct('group', shiftright(v, 33), 'hash', xxhash64(v),
                'done', if(s.group < 0, s.done, concat(s.done, array((s.hash & -32L) | shiftright(s.group, 25))))))),
    s -> if(s.group < 0, s.done, concat(s.done, array((s.hash & -32L) | shiftright(s.group, 25)))))"""


def lexicon(docs: DataFrame, text_col: str = "text", buckets: int = TERM_BUCKETS) -> list[int]:
    """The lexicon as 64-bit words of a bitmap over term buckets: ``buckets / 64`` numbers."""
    hashes = _HASHES.format(text=f"coalesce(`{text_col}`, '')")
    own = F.expr(f"explode(array_distinct(transform({hashes}, h -> cast(pmod(h, {buckets}L) as int))))")
    found = docs.select(own.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    most = max(MIN_DOCUMENTS, int(MAX_SHARE * docs.count()))
    words = (
        found.where(F.col("n").between(MIN_DOCUMENTS, most))
        .groupBy(F.shiftright("k", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, k & 63)")).alias("m"))
        .collect()
    )
    out = [0] * (buckets // 64)
    for row in words:
        out[row.w] = row.m
    return out


def with_signatures(rows: DataFrame, text_col: str, words: list[int], name: str) -> DataFrame:
    """Append ``name``: the signatures of the column's text, an array of longs by subset."""
    buckets = 64 * len(words)
    bitmap = f"from_json('{json.dumps(words)}', 'array<bigint>')"
    in_band = (
        f"get({bitmap}, cast(shiftright(pmod(h, {buckets}L), 6) as int)) & shiftleft(1L, cast(h & 63 as int)) <> 0"
    )
    keep = [F.col(f"`{c}`") for c in rows.columns]
    hashed = rows.select(*keep, F.expr(_HASHES.format(text=text_col)).alias("_all"))
    banded = hashed.select(*keep, "_all", F.expr(f"filter(_all, h -> {in_band})").alias("_band"))
    packed = banded.select(*keep, F.expr(_PACKED.format(terms="if(size(_band) > 0, _band, _all)")).alias("_packed"))
    return packed.select(*keep, F.expr(_SIGNATURES.format(packed="_packed")).alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of equal subset signatures among the subsets that either document meets."""
    subset = "transform({}, s -> s & 31)"
    either = F.expr(f"size(array_union({subset.format(a)}, {subset.format(b)}))")
    same = F.size(F.array_intersect(a, b))
    return F.when(either > 0, same / either).otherwise(F.lit(1.0))


def with_next(rows: DataFrame, columns: list[str], key: str, tie: str) -> DataFrame:
    """Append ``next_<c>`` of the row after each one, by descending ``key``, then ``tie``.

    After the last row comes the first.  Key ranges are cut at quantiles and
    evenly between them, so each row is shuffled once, to its range; the first
    row of a range also goes to the end of the range before it.
    """
    spark = rows.sparkSession
    keys = rows.select(key)
    n, low, high = keys.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if not n:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    ranges = max(2 * shuffle_partitions(spark), n // ROWS_A_BUCKET)
    shares = min(ranges, QUANTILES)
    parts = -(-ranges // shares)
    cuts = sorted(set(keys.agg(F.percentile_approx(key, [i / shares for i in range(1, shares)] or [0.5], 10000)).first()[0]))
    bounds = json.dumps([low, *[c for c in cuts if c > low]])
    array = f"from_json('{bounds}', 'array<bigint>')"
    share = F.expr(f"size(filter({array}, c -> c <= {key})) - 1")
    begin = F.expr(f"get({array}, _share)")
    end = F.expr(f"coalesce(get({array}, _share + 1), {high}L)")
    width = (end.cast("double") - begin) / parts
    part = F.when(width > 0, F.least(F.lit(parts - 1), F.floor((F.col(key).cast("double") - begin) / width))).otherwise(0)
    ranged = lambda d: d.withColumn("_share", share).withColumn("_range", F.col("_share") * parts + part.cast("int"))
    heads = ranged(keys).groupBy("_range").agg(F.max(key).alias("_head"))
    order = Window.orderBy("_range")  # as many rows as ranges
    first = heads.agg(F.min("_range")).first()[0]
    heads = materialize(
        heads.select("_range", "_head", F.coalesce(F.lead("_range").over(order), F.lit(first)).alias("_before")), "next-heads"
    )
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    copies = F.expr("if(_head is null, array(named_struct('r', _range, 'extra', false)),"
                    " array(named_struct('r', _range, 'extra', false), named_struct('r', _before, 'extra', true)))")
    joined = ranged(rows).join(heads.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & (F.col(key) == F.col("_head")), "left")
    dealt = joined.select(*rows.columns, F.explode(copies).alias("_c"))
    inside = Window.partitionBy("_c.r").orderBy("_c.extra", F.desc(key), tie)
    led = dealt.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns])
    return led.where("not _c.extra").drop("_c")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The edited text has its last third replaced by
    the beginning of the next document in descending ``doc_id`` order; null ids
    come last, and rows with one id follow by text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = lexicon(texts)
    own = with_signatures(texts.withColumn("key", F.coalesce("doc_id", F.lit(_LAST))), "text", words, "signs")
    led = with_next(own, ["text", "signs"], "key", "text")
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - tail), F.left("next_text", tail))
    edited_rows = led.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signs", "next_signs")
    signed = with_signatures(edited_rows, "edited", words, "edited_signs")
    written = lambda c: F.concat_ws("-", F.transform(c, lambda s: F.lower(F.hex(s))))
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("signs").alias("fingerprint"),
        written("edited_signs").alias("edited_fingerprint"),
        likeness("signs", "edited_signs").alias("near_edited"),
        likeness("signs", "next_signs").alias("near_next"),
    )
