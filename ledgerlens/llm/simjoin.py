"""Links between sets of hashes, from tiles of possible partners to components.

Sets are linked when ``100 * overlap >= 80 * union`` (the same as
``9 * overlap >= 4 * (size_a + size_b)``).  The steps:

1. A mapper packs postings (tile token, set id, size) into binary chunks by
   bucket; ``tile_table`` groups each bucket.  Inside a tile, members meet only
   in their own and the next size band.  A tile of up to ``TILE_PAIRS`` members
   gives all its pairs; a larger one becomes member rows, and those of one
   bucket with the same least set id are one tile from then on.
2. Member rows get a hub for each tile and band, by a grouped minimum, and are
   paired with the hub only: no pairs of a large group are listed.
   A pair's common tokens are counted over all tiles.  Where tokens are prefix
   elements in a common order, a linked pair has at least
   ``posted - (size - least overlap)`` of them in common, for one side at least.
3. A parity bitmap of each set bounds a pair's overlap from above: the sets
   differ in at least as many elements as the bitmaps in bits.
4. One surviving partner for each set is verified exactly on sorted arrays; the
   verified links give components.  In the large tiles, members outside the main
   component are tried with a few members of it.  Then every surviving pair
   between different components is verified, one for each two components first,
   and in the large tiles, grouped by their members, all
   members outside the main component are compared by bitmap, in blocks, with
   all others.
5. Components of all verified links.

No pair of different components is left out, so the result equals that of all
pairs; pairs inside one component need no check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialize, scratch_path
from .components import components
from .textops import U64
from .workers import released, released_group

TILE_PAIRS = 8
BLOCK = 512
TRIES = 4
UNCOUNTED = 256
MEMBER = np.dtype([("tok", "<i8"), ("sid", "<i8"), ("size", "<i4"), ("most", "<i4"), ("rare", "<i4")])
POSTING = np.dtype([("tok", "<u4"), ("sid", "<i8"), ("size", "<i4"), ("posted", "<u2")])
TILE_SCHEMA = "kind int, a long, b long, band int, size int, most int, rare int"
_TILE_ARROW = pa.schema(
    [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]
    + [(c, pa.int32()) for c in ("band", "size", "most", "rare")]
)


def band_of(size: np.ndarray) -> np.ndarray:
    """Size band: linked sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(1.25) + 1e-9).astype(np.int64)


def parity_bitmap(values: np.ndarray) -> bytes:
    """Bit ``h mod w`` is the parity of the elements there; ``w`` >= twice the size."""
    width = max(64, 1 << int(2 * len(values) - 1).bit_length())
    count = np.bincount((values & U64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def bucket_rows(postings: np.ndarray, token: np.ndarray, buckets: int, first: int = 0) -> tuple[list[int], list[bytes]]:
    """Packed postings by bucket; the upper half of the token chooses the bucket."""
    if not len(postings):
        return [], []
    own = ((token >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own, postings = own[order], postings[order]
    cut = np.flatnonzero(np.diff(own)) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(own)]])
    return [int(own[b]) + first for b in begin], [postings[b:e].tobytes() for b, e in zip(begin, end)]


def _tile_batch(kind: int, a, b, band=None, size=None, most=None, rare=None) -> pa.Table:
    n = len(a)
    blank = np.zeros(n, np.int32)
    columns = [np.full(n, kind, np.int32), a, b] + [blank if c is None else c.astype(np.int32) for c in (band, size, most, rare)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_TILE_ARROW)


def _reduce_tiles(buckets: int) -> Callable:
    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        bucket, raw = key[0].as_py(), b"".join(table.column("payload").to_pylist())
        if bucket >= buckets:
            m = np.unique(np.frombuffer(raw, MEMBER))
            return _tile_batch(1, m["tok"], m["sid"], band_of(m["size"]), m["size"], m["most"], m["rare"])
        p = np.frombuffer(raw, POSTING)
        # members of a tile together, by size
        order = np.lexsort((p["sid"], p["size"], p["tok"]))
        tok, sid, size = p["tok"][order], p["sid"][order], p["size"][order].astype(np.int64)
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
        tok, sid, size = tok[new], sid[new], size[new]
        band = band_of(size)
        head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        count = np.diff(np.concatenate([head, [len(tok)]]))
        tile = np.repeat(np.arange(len(head)), count)
        member = count[tile] <= TILE_PAIRS
        posted = p["posted"][order][new].astype(np.int64)
        left, right = [], []
        small = np.flatnonzero(member & (count[tile] > 1))
        for step in range(1, TILE_PAIRS):
            if not len(small):
                break
            small = small[small + step < len(tok)]
            near = small[tile[small + step] == tile[small]]
            near = near[band[near + step] - band[near] <= 1]
            near = near[9 * size[near] >= 4 * (size[near] + size[near + step])]
            left.append(near)
            right.append(near + step)
            small = near  # sizes ascend: once too far, later ones are too
        parts = []
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            swap = sid[x] > sid[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            total = size[x] + size[y]
            slack = np.minimum(posted[x] - size[x], posted[y] - size[y]) + (4 * total + 8) // 9
            pairs = np.stack([sid[x], sid[y], slack], 1)
            pairs, shared = np.unique(pairs, axis=0, return_counts=True)
            parts.append(_tile_batch(0, pairs[:, 0], pairs[:, 1], size=shared, most=pairs[:, 2]))
        if not member.all():
            # tiles with the same least member are one, as in ``tile_groups``
            big = np.flatnonzero(~member)
            least = np.minimum.reduceat(sid, head)[tile[big]]
            order = np.lexsort((tok[big], sid[big], least))
            big, least = big[order], least[order]
            new = np.ones(len(big), bool)
            new[1:] = (least[1:] != least[:-1]) | (sid[big[1:]] != sid[big[:-1]])
            big, least = big[new], least[new]
            named = np.concatenate([[True], least[1:] != least[:-1]])
            key_of = (np.int64(bucket) << np.int64(32)) | tok[big][named][np.cumsum(named) - 1].astype(np.int64)
            parts.append(_tile_batch(1, key_of, sid[big], band[big], size[big], 5 * size[big] // 4, np.full(len(big), UNCOUNTED)))
        return pa.concat_tables(parts) if parts else _TILE_ARROW.empty_table()

    return reduce


def tile_table(postings: DataFrame, buckets: int, name: str) -> DataFrame:
    """Pairs (kind 0) and members of large tiles (kind 1) from ``(bucket, payload)`` rows.

    A pair's ``size`` is its number of common tokens in the bucket, ``most`` the
    number that a linked pair needs in all.

    Buckets from ``buckets`` on hold ``MEMBER`` records of tiles that are known
    to be large, dealt out by set; a large tile is so never in one group.
    """
    grouped = postings.groupBy("bucket").applyInArrow(released_group(_reduce_tiles(buckets)), TILE_SCHEMA)
    return materialize(grouped, f"{name}-tiles")


def _words(column: pa.Array, pick: np.ndarray) -> np.ndarray:
    """Binary cells of one length as a matrix of 64-bit words."""
    cells = column.take(pa.array(pick)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.take(pa.array(pick))
    raw, offsets = cells.buffers()[2], np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(raw, U64, count=(offsets[-1] - offsets[0]) // 8, offset=int(offsets[0])).reshape(len(pick), -1)


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _differing_bits(left: pa.Array, right: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    a, b = (np.asarray(pc.binary_length(c)).astype(np.int64) for c in (left, right))
    out = np.zeros(len(a), np.int64)
    for la, lb in np.unique(np.stack([a, b], 1), axis=0):
        pick = np.flatnonzero((a == la) & (b == lb))
        width = min(la, lb) // 8
        x = _fold(_words(left, pick), width) ^ _fold(_words(right, pick), width)
        out[pick] = np.bitwise_count(x).sum(axis=1)
    return out


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sa, sb = (batch.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
        keep = 9 * np.minimum(sa, sb) >= 4 * (sa + sb)
        keep &= 9 * _differing_bits(batch.column("bits_a"), batch.column("bits_b")) <= sa + sb
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def bounded_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps allow the similarity."""
    a = items.select(F.col("sid").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    b = items.select(F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(released(_bounded), "a long, b long")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("set_a"), batch.column("set_b")
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(c[i].as_buffer(), U64) for c in (left, right))
            overlap = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 9 * overlap >= 4 * (len(x) + len(y))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sorted arrays intersect far enough."""
    a = sets.select(F.col("sid").alias("a"), F.col("elements").alias("set_a"))
    b = sets.select(F.col("sid").alias("b"), F.col("elements").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(released(_exact), "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near_sizes(a: str, b: str) -> Column:
    """Whether sets of these sizes can be linked."""
    return 9 * F.least(a, b).cast("long") >= 4 * (F.col(a).cast("long") + F.col(b))


def listed_pairs(tiles: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of the small tiles with enough common tokens in all of them.

    A set with tokens in a tile that listed no pairs is exempt from the count.
    """
    pairs = tiles.where("kind = 0").groupBy("a", "b").agg(F.sum("size").alias("shared"), F.max("most").alias("need"))
    uncounted = members.where(f"rare = {UNCOUNTED}").select("sid").distinct()
    a, b = (uncounted.select(F.col("sid").alias(c), F.lit(True).alias(f"free_{c}")) for c in "ab")
    flagged = pairs.join(a, "a", "left").join(b, "b", "left")
    return flagged.where("shared >= need or free_a or free_b").select("a", "b")


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a large tile with the hub of its band and of the band below.

    The hub has the smallest share of rare elements, then the most large tiles:
    the likeliest centre.
    """
    tiles = members.groupBy("sid").agg((-F.count(F.lit(1))).alias("tiles"))
    hubs = members.join(tiles, "sid").groupBy("tok", "band").agg(F.min(F.struct("rare", "tiles", "sid", "size")).alias("h"))
    # not a union of two bands: that would find the hubs twice
    hubs = hubs.select("tok", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("h.sid").alias("hub"), F.col("h.size").alias("hub_size"))
    own = members.select("tok", "band", "sid", "size")
    pairs = own.join(hubs, ["tok", "band"]).where(_near_sizes("size", "hub_size"))
    return pairs.where("sid <> hub").select(*_ordered("sid", "hub")).distinct()


def _block_pairs(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    side = np.asarray(table.column("side"))
    rest, full = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(rest) or not len(full):
        return _PAIRS.empty_table()
    tok, band = key[0].as_py(), key[1].as_py()
    sid, label, size, most = (np.asarray(table.column(c)).astype(np.int64) for c in ("sid", "label", "size", "most"))
    own_band = band_of(size)
    tiles = table.column("tiles").chunk(0)
    tile_at = np.asarray(tiles.offsets).astype(np.int64)
    tile_of, tile_most = (np.asarray(tiles.values.field(c)).astype(np.int64) for c in ("tok", "most"))
    cells = table.column("bits").chunk(0)
    import pyarrow.compute as pc

    length = np.asarray(pc.binary_length(cells)).astype(np.int64)

    def given(r: int, mine: np.ndarray, h: int) -> bool:
        own = slice(tile_at[h], tile_at[h + 1])
        _, x, y = np.intersect1d(tile_of[mine], tile_of[own], assume_unique=True, return_indices=True)
        return bool(((size[h] <= tile_most[mine][x]) & (size[r] <= tile_most[own][y])).any())

    found = []
    for width_r in np.unique(length[rest]):
        rows = rest[length[rest] == width_r]
        rows_bits = _words(cells, rows)
        for width_f in np.unique(length[full]):
            others = full[length[full] == width_f]
            width = min(width_r, width_f) // 8
            others_bits = _fold(_words(cells, others), width)
            for r, bits in zip(rows, _fold(rows_bits, width)):
                total = size[r] + size[others]
                ok = (label[others] != label[r]) & (9 * np.minimum(size[r], size[others]) >= 4 * total)
                ok &= (size[others] <= most[r]) & (size[r] <= most[others])
                # two sets of one band also meet in the next band's tile
                ok &= np.maximum(own_band[others], own_band[r]) == band
                at = np.flatnonzero(ok)
                if len(at):
                    differ = np.bitwise_count(others_bits[at] ^ bits).sum(axis=1)
                    hit = others[at[9 * differ.astype(np.int64) <= total[at]]]
                    # a pair is given once: in the first common tile that does not rule it out by position
                    mine = np.arange(tile_at[r], tile_at[r + 1])
                    mine = mine[tile_of[mine] < tok]
                    if len(mine) and len(hit):
                        hit = hit[[not given(r, mine, h) for h in hit]]
                    if len(hit):
                        found.append(np.stack([np.minimum(sid[r], sid[hit]), np.maximum(sid[r], sid[hit])], 1))
    if not found:
        return _PAIRS.empty_table()
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIRS)


def tile_groups(members: DataFrame) -> DataFrame:
    """Members of large tiles by groups of tiles: ``tok`` is the group, ``most`` the loosest bound in it.

    The elements of one passage, or of one family of copies, make tiles with
    nearly the same members.  Tiles whose members have the same least set id,
    itself a hash, become one group, so such tiles compare their members once instead of
    once each.  Sets that meet in a tile meet in its group, so no pair is lost.
    """
    least = members.groupBy("tok").agg(F.min("sid").alias("group"))
    grouped = members.join(least, "tok").groupBy("group", "sid", "band", "size")
    return grouped.agg(F.max("most").alias("most")).withColumnRenamed("group", "tok")


def mixed_groups(groups: DataFrame, labels: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Members of the groups and bands with several components: ``label``, the group's ``main`` one, ``n``, ``low``.

    ``main`` has the most members, ``low`` is the least size in the group.
    """
    named = groups.join(labels.withColumnRenamed("id", "sid"), "sid", "left")
    named = named.withColumn("label", F.coalesce("label", "sid"))
    spread = materialize(
        named.select("sid", "label", "size", "most", "tok", F.explode(F.array("band", F.col("band") + 1)).alias("band")),
        f"{name}-members",
        folder,
    )
    by_label = spread.groupBy("tok", "band", "label").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"))
    tiles = (
        by_label.groupBy("tok", "band")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("main"), F.min("low").alias("low"))
        .where("k > 1")
        .select("tok", "band", "n", "main", "low")
    )
    return materialize(spread.join(tiles, ["tok", "band"]), f"{name}-mixed", folder)


def tried_pairs(mixed: DataFrame, tries: int = TRIES) -> DataFrame:
    """Each member outside its group's main component with ``tries`` members of that component.

    The least of several hashes choose them.  Most copies of one family link with
    one of them, so that few members are left for the comparison with all.
    """
    least = [F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("h"), "sid", "size")).alias(f"m{k}") for k in range(tries)]
    chosen = mixed.where("label = main").groupBy("tok", "band").agg(*least)
    chosen = chosen.select("tok", "band", F.array_distinct(F.array(*[F.struct(f"m{k}.sid", f"m{k}.size") for k in range(tries)])).alias("hubs"))
    rest = mixed.where("label <> main and most >= low").select("tok", "band", "sid", "size")
    pairs = rest.join(chosen, ["tok", "band"]).select("sid", "size", F.explode("hubs").alias("hub"))
    return pairs.where(_near_sizes("size", "hub.size")).select(*_ordered("sid", "hub.sid")).distinct()


def rest_pairs(members: DataFrame, labels: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """Possible links between different components inside large tiles, without any link tried before."""
    return block_pairs(mixed_groups(materialize(tile_groups(members), f"{name}-groups"), labels, name), items)


def block_pairs(mixed: DataFrame, items: DataFrame) -> DataFrame:
    """Possible links between different components inside the groups.

    In each group of tiles the members outside its main component are compared
    by bitmap with all others, block by block; a member whose prefix position
    rules out every size in the group is left out.
    """
    rest = mixed.where("label <> main and most >= low")
    sizes = [F.min("size").alias("r_low"), F.max("size").alias("r_high")]
    counts = rest.groupBy("tok", "band").agg(F.count(F.lit(1)).alias("r"), *sizes)
    cols = ["tok", "band", "sid", "label", "size", "most"]
    chunk = lambda n: F.ceil(F.col(n) / BLOCK).alias(n)
    left = rest.join(counts, ["tok", "band"]).select(*cols, F.lit(0).alias("side"), chunk("r"), chunk("n"))
    near = "5L * size >= 4L * r_low and 4L * size <= 5L * r_high"  # others fit no size of the rest
    right = mixed.join(counts, ["tok", "band"]).where(near).select(*cols, F.lit(1).alias("side"), chunk("r"), chunk("n"))
    # a set's groups: no more than it has tokens, as a rule a few; a group that does
    # not compare its members gives no pair, so it need not be known
    own_groups = mixed.select("sid", "tok", "most").distinct()
    tiles_of = own_groups.groupBy("sid").agg(F.collect_set(F.struct("tok", "most")).alias("tiles"))
    known = items.select("sid", "bits").join(tiles_of, "sid")
    # joined before the rows are dealt out to blocks: a large group does not meet its sets once for each block
    both = left.unionByName(right).join(known, "sid")
    rest_side = F.col("side") == 0
    every = F.sequence(F.lit(0).cast("long"), F.when(rest_side, F.col("n")).otherwise(F.col("r")) - 1)
    own = F.pmod(F.xxhash64("sid"), F.when(rest_side, F.col("r")).otherwise(F.col("n")))
    both = both.select(*cols, "side", "bits", "tiles", own.alias("own"), F.explode(every).alias("other"))
    i, j = (F.when(c, F.col("own")).otherwise(F.col("other")) for c in (rest_side, ~rest_side))
    both = both.select(*cols, "side", "bits", "tiles", i.alias("i"), j.alias("j"))
    return both.groupBy("tok", "band", "i", "j").applyInArrow(released_group(_block_pairs), "a long, b long").distinct()


def linked_components(
    tiles: DataFrame, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """``(id, label)`` of the set ids that are linked with another one.

    ``items``: ``sid, size, bits``, one row for each set.  ``sets_of`` takes the
    wanted set ids, written, as ``sid`` and returns ``sid, elements``, sorted, at
    least for those; repeated rows for one set are allowed.
    """
    spark = tiles.sparkSession
    folder = scratch_path(spark, f"{name}-steps")  # all but the labels, removed at the end
    members = tiles.where("kind = 1").selectExpr("a as tok", "b as sid", "band", "size", "most", "rare").distinct()
    listed = listed_pairs(tiles, members).unionByName(hub_pairs(members)).distinct()
    survivors = materialize(bounded_pairs(listed, items), f"{name}-survivors", folder)
    first = materialize(survivors.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), f"{name}-first", folder)
    labels = components(_verified(first, sets_of, name, folder), name)
    groups = materialize(tile_groups(members), f"{name}-groups", folder)
    tried = materialize(bounded_pairs(tried_pairs(mixed_groups(groups, labels, name, folder)), items), f"{name}-tried", folder)
    labels = _with_links(labels, tried, sets_of, name, folder)
    possible = survivors.unionByName(block_pairs(mixed_groups(groups, labels, name, folder), items)).distinct()
    possible = materialize(possible, f"{name}-possible", folder)
    # one pair for each two components comes first: those that it merges need no other
    chosen = _between(possible, labels).groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
    chosen = chosen.agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    labels = _with_links(labels, chosen, sets_of, name, folder)
    labels = _with_links(labels, possible, sets_of, name, folder)
    delete_path(spark, folder)
    return labels


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], name: str, folder: str) -> DataFrame:
    """The written ``pairs`` whose sets, fetched for these pairs alone, intersect far enough."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), f"{name}-ends", folder)
    # not written: one shuffle by set id serves the removal of repeats and both joins
    sets = sets_of(ends).join(ends, "sid", "left_semi").dropDuplicates(["sid"])
    return materialize(verified_pairs(pairs, sets), f"{name}-links", folder)


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components, ``a, b, la, lb``."""
    la, lb = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    named = pairs.join(la, "a", "left").join(lb, "b", "left")
    named = named.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
    return named.where("la <> lb").select("a", "b", "la", "lb")


def _with_links(labels: DataFrame, pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], name: str, folder: str) -> DataFrame:
    """The labels, outside ``folder``, after the verification of those pairs that lie between components."""
    between = materialize(_between(pairs, labels).select("a", "b"), f"{name}-between", folder)
    if between.isEmpty():
        return labels
    more = _verified(between, sets_of, name, folder)
    if more.isEmpty():
        return labels
    # a component is one node: its links are not walked again
    named = _between(more, labels).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(named, name).withColumnRenamed("id", "old").withColumnRenamed("label", "new")
    old = labels.unionByName(named.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").withColumn("label", F.col("id")))
    fresh = old.join(merged, old["label"] == merged["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
    return materialize(fresh, f"{name}-labels")
