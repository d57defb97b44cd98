"""Global ranks and row numbers without a single-partition window.

``percent_rank() OVER (ORDER BY x)`` and ``row_number() OVER (ORDER BY k)``
have no PARTITION BY, so Spark plans them behind ``Exchange SinglePartition``:
every row of the input would pass through one task.  This module computes
the same numbers with ordinary shuffles whose partitions are bounded.

Quintile scores (tie-aware RFM scores)
--------------------------------------
``score(x) = least(5, floor(percent_rank(x) * 5) + 1)`` with
``percent_rank(x) = less(x) / (N - 1)``, where ``less(x)`` counts rows whose
value is strictly smaller.  The score is a non-decreasing step function of
``x``, so it is fully described by at most five break values — the smallest
``x`` reaching each score: the value after the ``k``-th smallest one, for a
``k`` that follows from ``N`` alone.  All of them are selected together:

1. one aggregate gives each metric's ``N``, least and greatest value;
2. each open range, at first the whole one, is cut into a fixed number of equal
   parts; one aggregate counts the rows of each part and keeps its least and
   greatest value;
3. the part that holds the ``k``-th value is the next range.  Once its least
   and greatest value are equal, that is the value, and the next part's least
   value is the break.

Every step is a grouped aggregate with at most ``metrics × 4 × PARTS`` result
rows, whatever the number of rows: no sort, no window, no sampled bounds.  Three
or four steps reach a value, as each makes a range ``PARTS`` times shorter.

Applying the breaks is then a plain CASE expression on each input row — no
join back to the (customer-sized) input.  Range ends are literals that occur in
the data, so re-running a task after executor loss counts the same.

Row numbers
-----------
``row_number_by`` range-partitions on the order key, numbers rows inside
each partition with ``monotonically_increasing_id`` and writes the result to
the shared checkpoint folder (fixing partition membership), then adds the
count of rows in earlier partitions.  Requires a total order key (ties
between rows that differ elsewhere would be numbered arbitrarily, as in SQL).

``row_number_by_position`` is the cheaper form for an integer position that
is unique within its group (a physical row number): it counts the marks of a
small table of the positions that occur, and neither sorts nor exchanges rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

SCORE_LEVELS = 5
PARTS = 1024  # parts of a range in one step of the selection
_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition
SORT_ROWS = 400_000  # rows of one sort, some 100 MB of transaction lines
_WORD_BITS = 6  # 64 positions are marked in a word
_ROW_BITS = 6  # 64 words in a row of marks
_STRETCH_BITS = 10  # 1024 rows of marks are summed up in one task
MARK_ROWS = 1 << 18  # so many rows of marks are broadcast, some 180 MB for 1 G positions


# --------------------------------------------------------------------------
# quintile scores
# --------------------------------------------------------------------------


class _Range(NamedTuple):
    """Where the value of one rank lies: closed bounds, rows below, the least value above."""

    low: float
    high: float
    below: int
    above: float | None


def least_rank(total: int, score: int, levels: int) -> int:
    """How many smaller values a value needs to reach ``score``, with the arithmetic of ``percent_rank``."""
    rank = max(0, (score - 1) * (total - 1) // levels - 1)
    while rank < total and math.floor(rank / max(total - 1, 1) * float(levels)) < score - 1:
        rank += 1
    return rank


def _part_of(x: Column, low: float, high: float, parts: int) -> Column:
    """The part of ``[low, high]`` that holds ``x``; the greatest value has one of its own."""
    width = high * 0.5 - low * 0.5
    if not width:  # neighbouring values
        return F.when(x > F.lit(low), F.lit(parts)).otherwise(F.lit(0))
    return F.floor((x * F.lit(0.5) - F.lit(low * 0.5)) / F.lit(width) * F.lit(float(parts))).cast("int")


def _refined(at: _Range, rank: int, parts: list[tuple[int, float, float]]) -> _Range:
    """The part with the ``rank``-th smallest value (from one), given ``(rows, least, greatest)`` in order."""
    below, ends = at.below, [least for _, least, _ in parts[1:]] + [at.above]
    for (rows, least, greatest), above in zip(parts, ends):
        if below + rows >= rank:
            return _Range(least, greatest, below, above)
        below += rows
    raise RuntimeError("the input changed between two steps of the selection")


def score_breaks(
    df: DataFrame,
    columns: Sequence[str],
    levels: int = SCORE_LEVELS,
    buckets: int | None = None,
) -> dict[str, list[tuple[float, int]]]:
    """Exact break values of the tie-aware ``levels``-quantile score.

    Returns, per column, ``[(min value, score), …]`` ascending.  ``buckets``
    sets the number of parts of a range (``PARTS``).  A few small actions run,
    see the module's description; pass a materialised ``df`` when it is
    expensive to recompute.  NULLs have no rank; values must be finite.
    """
    parts = max(2, buckets or PARTS)
    x = [F.col(c).cast("double") for c in columns]
    bounds = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    out: dict[str, list[tuple[float, int]]] = {c: [] for c in columns}
    ranges: dict[tuple[int, int], tuple[int, _Range]] = {}
    for i, c in enumerate(columns):
        total, low, high = bounds[f"n{i}"], bounds[f"low{i}"], bounds[f"high{i}"]
        if not total:
            continue
        if not (math.isfinite(low) and math.isfinite(high)):
            raise ValueError(f"{c} has values that are not finite")
        out[c].append((low, 1))
        for score in range(2, levels + 1):
            rank = least_rank(total, score, levels)
            if 0 < rank < total:
                ranges[i, score] = (rank, _Range(low, high, 0, None))
            elif rank == 0:
                out[c].append((low, score))
    while ranges:
        wanted = sorted({(i, at.low, at.high) for (i, _), (_, at) in ranges.items() if at.low < at.high})
        counted: dict[int, list] = {k: [] for k in range(len(wanted))}
        if wanted:
            cells = [
                F.when(x[i].between(low, high), F.struct(F.lit(k).alias("k"), _part_of(x[i], low, high, parts).alias("part"), x[i].alias("x")))
                for k, (i, low, high) in enumerate(wanted)
            ]
            rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.k", "c.part", "c.x")
            for row in rows.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
                counted[row.k].append((row.part, row.n, row.low, row.high))
        by_range = {w: [cell[1:] for cell in sorted(counted[k])] for k, w in enumerate(wanted)}
        open_ranges = {}
        for (i, score), (rank, at) in ranges.items():
            if at.low < at.high:
                at = _refined(at, rank, by_range[i, at.low, at.high])
            if at.low < at.high:
                open_ranges[i, score] = (rank, at)
            elif at.above is not None:
                out[columns[i]].append((at.above, score))
        ranges = open_ranges
    for c in columns:
        # the highest score of a value counts
        best = {}
        for value, score in sorted(out[c]):
            best[float(value)] = score
        out[c] = sorted(best.items())
    return out


def score_from_breaks(column: str, breaks: Sequence[tuple[float, int]]) -> Column:
    """CASE expression mapping a value to its score given ``score_breaks``."""
    if not breaks:
        return F.lit(None).cast("int")
    x = F.col(column).cast("double")
    expr = None
    for value, score in sorted(breaks, reverse=True):
        cond = x >= F.lit(value)
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    # values below the smallest break cannot occur for rows that were ranked
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(
        expr.otherwise(F.lit(breaks[0][1]))
    )


def quantile_scores(
    df: DataFrame,
    columns: Sequence[str],
    names: Sequence[str],
    inverted: Sequence[bool] | None = None,
    levels: int = SCORE_LEVELS,
    buckets: int | None = None,
) -> DataFrame:
    """Append tie-aware 1..``levels`` scores for ``columns`` as ``names``.

    ``inverted[i]`` gives ``levels + 1 - score`` (small values score high, as
    recency does).
    """
    inverted = list(inverted or [False] * len(columns))
    breaks = score_breaks(df, columns, levels=levels, buckets=buckets)
    new_cols = {}
    for c, name, inv in zip(columns, names, inverted):
        s = score_from_breaks(c, breaks[c])
        new_cols[name] = (F.lit(levels + 1) - s).cast("int") if inv else s.cast("int")
    return df.withColumns(new_cols)


def window_quantile_scores(
    df: DataFrame,
    columns: Sequence[str],
    names: Sequence[str],
    inverted: Sequence[bool] | None = None,
    levels: int = SCORE_LEVELS,
) -> DataFrame:
    """The same scores with the built-in global ``percent_rank`` window.

    Plans ``Exchange SinglePartition``; kept only as a test oracle for
    ``quantile_scores`` on small inputs.
    """
    inverted = list(inverted or [False] * len(columns))
    new_cols = {}
    for c, name, inv in zip(columns, names, inverted):
        pr = F.percent_rank().over(Window.orderBy(F.col(c).asc_nulls_last()))
        s = F.least(F.lit(levels), F.floor(pr * F.lit(float(levels))).cast("int") + 1)
        new_cols[name] = (F.lit(levels + 1) - s).cast("int") if inv else s.cast("int")
    return df.withColumns(new_cols)


# --------------------------------------------------------------------------
# row numbers
# --------------------------------------------------------------------------


def sort_partitions(spark: SparkSession, rows: int) -> int:
    """So many partitions that a task sorts ``SORT_ROWS`` of ``rows`` rows, and no fewer than set for shuffles."""
    return max(shuffle_partitions(spark), -(-rows // SORT_ROWS))


def dealt_by_range(df: DataFrame, keys: Sequence[str | Column], rows: int | None = None) -> DataFrame:
    """``repartitionByRange`` whose parts, of ``rows`` rows in all, are small enough to sort in memory."""
    parts = sort_partitions(df.sparkSession, rows or 0)
    more = [parts] if parts > shuffle_partitions(df.sparkSession) else []  # else as set, and merged when small
    return df.repartitionByRange(*more, *keys)


def row_number_by(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "row_number",
    partition_by: Sequence[str] = (),
    num_partitions: int | None = None,
    start: int = 1,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY … ORDER BY …)`` for few, huge groups.

    Range partitioning splits even one hot group across many tasks by the
    order key.  Output keeps every input column plus ``name`` (bigint).
    For many small groups use an ordinary window instead.

    The rows are exchanged, sorted and written once with all their columns, so
    pass narrow ones and derive others from the result.  A task sorts its
    ``num_partitions``-th part in memory: see ``sort_partitions``.
    """
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    keys = [F.col(c) if isinstance(c, str) else c for c in (*partition_by, *order_by)]
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rn_id", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "row-number").withColumn(
        "_rn_part", F.shiftright(F.col("_rn_id"), _LOCAL_BITS)
    )
    group_cols = [*partition_by, "_rn_part"]
    stats = ranged.groupBy(*group_cols).agg(
        F.min("_rn_id").alias("_rn_first"), F.count(F.lit(1)).alias("_rn_rows")
    )
    earlier = (
        Window.partitionBy(*partition_by) if partition_by else Window.partitionBy()
    ).orderBy("_rn_part").rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: f"_rn_key{i}" for i, c in enumerate(group_cols)}
    offsets = stats.select(
        *[F.col(c).alias(renamed[c]) for c in group_cols],
        "_rn_first",
        F.coalesce(F.sum("_rn_rows").over(earlier), F.lit(0)).alias("_rn_before"),
    )
    # one row per (group, range partition): at most groups + partitions rows, as
    # a partition holds a range; broadcast, so that the rows stay where they are
    cond = [F.col(c).eqNullSafe(F.col(renamed[c])) for c in group_cols]
    joined = ranged.join(F.broadcast(offsets), cond, "inner")
    number = (
        F.col("_rn_before") + (F.col("_rn_id") - F.col("_rn_first")) + F.lit(start)
    ).cast("bigint")
    return joined.select(*df.columns, number.alias(name))


def row_number_by_position(
    df: DataFrame,
    group: str | Column,
    position: str,
    name: str = "row_number",
    rows_per_bucket: int = 1 << 22,
    start: int = 1,
    folder: str | None = None,
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``row_number() OVER (ORDER BY group, position)`` for integer positions.

    ``position`` is unique within a group (a physical row number is).  One
    aggregate over the two key columns marks the positions that occur, 64 of
    them in a word, a few thousand in a row of a small table that is written to
    ``folder`` or the shared folder.  A row's number is the count of marks before its own: the
    rows themselves are neither sorted nor exchanged while that table, about 1.4
    bits for each position, is small enough to broadcast (``MARK_ROWS``), and
    joined to it by key beyond.  Rows without a position are left out.

    Should positions repeat, rows are numbered by one window per (group, value
    bucket of ``rows_per_bucket`` positions) instead; equal ones in any order.

    ``deal`` deals the rows out anew, and may add columns.  It is called before the
    numbers are added where they leave the rows in place, so that what is derived
    from them is neither exchanged nor computed for the bounds of ranges.
    """
    deal = deal or (lambda rows: rows)
    g = F.col(group) if isinstance(group, str) else group
    at = F.col(position).cast("bigint")
    word, bit = F.shiftright(at, _WORD_BITS), at.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")
    marks = _position_marks(df.where(at.isNotNull()).select(g.alias("_rp_g"), word.alias("_rp_word"), bit.alias("_rp_bit")), folder)
    found = marks.agg(F.count(F.lit(1)).alias("n"), F.max("_rp_repeated").alias("repeated")).first()
    if found["repeated"]:
        return deal(_row_number_by_window(df, g, position, name, rows_per_bucket, start))
    marks = marks.drop("_rp_repeated")
    small = found["n"] <= MARK_ROWS
    rows = deal(df.where(at.isNotNull())) if small else df
    joined = rows.withColumns({"_rp_group": g, "_rp_row": F.shiftright(at, _WORD_BITS + _ROW_BITS)}).join(
        F.broadcast(marks) if small else marks,
        F.col("_rp_group").eqNullSafe(F.col("_rp_g")) & (F.col("_rp_row") == F.col("_rp_r")),
    )
    place = word.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).cast("int")
    earlier = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bit))  # the lower bits of the word
    number = (
        F.col("_rp_first")
        + F.get("_rp_before", place)
        + F.bit_count(F.get("_rp_words", place).bitwiseAND(earlier))
        + F.lit(start)
    )
    numbered = joined.select(*rows.columns, number.cast("bigint").alias(name))
    return numbered if small else deal(numbered)


def _position_marks(keys: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per group and ``2 ** (_WORD_BITS + _ROW_BITS)`` positions: marks, and marks before.

    ``_rp_words`` holds a mark for each position that occurs, ``_rp_before`` how
    many marks of the row come before each word, ``_rp_first`` how many come
    before the row.
    """
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_rp_bit"))
    words = keys.groupBy("_rp_g", "_rp_word").agg(F.count(F.lit(1)).alias("rows"), F.bit_or(mark).alias("bits"))
    row, place = F.shiftright("_rp_word", _ROW_BITS), F.col("_rp_word").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    cells = F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("place"), F.struct("bits", "rows").alias("cell"))))
    held = words.groupBy("_rp_g", row.alias("_rp_r")).agg(
        F.sum("rows").alias("rows"), F.max(F.col("rows") != F.bit_count("bits")).alias("_rp_repeated"), cells.alias("cells")
    )
    places = F.sequence(F.lit(0), F.lit((1 << _ROW_BITS) - 1))
    counts = F.transform(places, lambda i: F.coalesce(F.try_element_at("cells", i)["rows"], F.lit(0)).cast("int"))
    held = materialize(
        held.select(
            "_rp_g", "_rp_r", "rows", "_rp_repeated",
            F.transform(places, lambda i: F.coalesce(F.try_element_at("cells", i)["bits"], F.lit(0))).alias("_rp_words"),
            counts.alias("counts"),
        ),
        "position-marks",
        folder,
    )
    # marks before a row: inside its stretch of rows, then over the stretches
    stretch = F.shiftright("_rp_r", _STRETCH_BITS).alias("_rp_s")
    inside = Window.partitionBy("_rp_g", "_rp_s").orderBy("_rp_r").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_rp_g2", "_rp_s2").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(F.col("_rp_g").alias("_rp_g2"), stretch.alias("_rp_s2")).agg(F.sum("rows").alias("total"))
    totals = totals.select("_rp_g2", "_rp_s2", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("before"))
    placed = held.select("*", stretch).withColumn("own", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    joined = placed.join(totals, F.col("_rp_g").eqNullSafe(F.col("_rp_g2")) & (F.col("_rp_s") == F.col("_rp_s2")))
    before = F.transform(
        places, lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0), lambda total, n: total + n).cast("smallint")
    )
    return joined.select(
        "_rp_g", "_rp_r", (F.col("before") + F.col("own")).alias("_rp_first"), "_rp_words", before.alias("_rp_before"), "_rp_repeated"
    )


def _row_number_by_window(df: DataFrame, g: Column, position: str, name: str, rows_per_bucket: int, start: int) -> DataFrame:
    """The numbers of ``row_number_by_position`` where positions repeat."""
    keyed = df.withColumns(
        {
            "_rp_group": g,
            "_rp_bucket": F.floor(F.col(position) / F.lit(rows_per_bucket)).cast("bigint"),
        }
    )
    ranked = keyed.withColumn(
        "_rp_rank",
        F.row_number().over(Window.partitionBy("_rp_group", "_rp_bucket").orderBy(position)),
    )
    earlier = Window.orderBy("_rp_group", "_rp_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_rp_group", "_rp_bucket")
        .agg(F.count(F.lit(1)).alias("_rp_rows"))
        .select(
            F.col("_rp_group").alias("_rp_g"),
            F.col("_rp_bucket").alias("_rp_b"),
            F.coalesce(F.sum("_rp_rows").over(earlier), F.lit(0)).alias("_rp_before"),
        )
    )
    joined = ranked.join(
        offsets,
        (F.col("_rp_group").eqNullSafe(F.col("_rp_g"))) & (F.col("_rp_bucket") == F.col("_rp_b")),
    )
    number = (F.col("_rp_before") + F.col("_rp_rank") + F.lit(start - 1)).cast("bigint")
    return joined.select(*df.columns, number.alias(name))
