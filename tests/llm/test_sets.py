"""The n-gram join and substring dedup against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, ngram_join, quality, simjoin, substring_dedup, textops
from ledgerlens.llm.components import components
from ledgerlens.llm.queries import VOCABULARY
from ledgerlens.llm.textops import mix, word_hashes

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts: dict) -> dict:
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def test_join_equals_brute_force(docs):
    found = ngram_join.ngram_jaccard_components(docs).where("doc_id is not null").collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = brute_components(texts)
    assert len(found) == docs.where("doc_id is not null").count()
    for r in found:
        assert (r.n_shingles, r.component_id) == (len(shingles(texts[r.doc_id])), want[r.doc_id])


@pytest.mark.parametrize("tile_pairs", [2, 32])
def test_large_groups_lose_no_link(spark, monkeypatch, tile_pairs):
    """Near copies of one text with few to many edits; small tiles force the hub path."""
    import random

    monkeypatch.setattr(simjoin, "TILE_PAIRS", tile_pairs)
    monkeypatch.setattr(ngram_join, "HOT_IN_BATCH", 10**9 if tile_pairs == 2 else 4)
    base, rng, texts = prose(20, 100).split(" "), random.Random(5), {}
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(frame).collect()}
    assert found == brute_components(texts)


def test_rest_pairs_give_each_link_between_components(spark):
    """Prefixes of hot elements in random tiles: the smallest common tile may rule a pair out by position."""
    rng, sets, members, items = np.random.default_rng(3), [], [], []
    token = rng.permutation(10**6)[:400]  # tile name of each element; elements are in the common order
    for _ in range(6):
        base = rng.permutation(400)[:80]
        for _ in range(12):
            own = set(base.tolist())
            for e in rng.permutation(base)[: rng.integers(2, 9)]:
                own.discard(int(e))
            own |= set(rng.permutation(400)[: rng.integers(0, 6)].tolist())
            sets.append(sorted(own))
    for sid, own in enumerate(sets):
        size = len(own)
        values = np.sort(mix(np.array(own, np.uint64)))
        items.append((sid, size, simjoin.parity_bitmap(values)))
        for place in range(size - (4 * size + 4) // 5 + 1):
            most = 9 * (size - place) // 4 - size
            if most >= (4 * size + 4) // 5:
                members.append((int(token[own[place]]), sid, int(simjoin.band_of(np.array([size]))[0]), size, most, 0))
    frames = [
        spark.createDataFrame(members, "tok long, sid long, band int, size int, most int, rare int"),
        spark.createDataFrame([(i, i % 2) for i in range(len(sets))], "id long, label long"),
        spark.createDataFrame(items, "sid long, size int, bits binary"),
    ]
    found = {(r.a, r.b) for r in simjoin.rest_pairs(*frames, "rest").collect()}
    links = {
        (a, b)
        for a, b in combinations(range(len(sets)), 2)
        if (a - b) % 2 and 9 * len(set(sets[a]) & set(sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
    }
    assert len(links) > 100 and links <= found


def test_one_of_each_group_stays(docs):
    kept = ngram_join.one_of_each_group(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15]
    assert ids.count(None) == 2


@pytest.mark.parametrize("taken", [["_key"], ["_KEY", "_Key_"], ["ids", "N_Tokens", "_text", "_cut", "spans"]])
def test_columns_with_the_operators_own_names_stay(spark, docs, taken):
    """Names are told apart as Spark does it, without case; no column is lost, doubled or changed."""
    wide = docs.select("*", *[F.concat_ws(":", F.lit(c), "doc_id").alias(c) for c in taken])
    bench = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for stage in (
        ngram_join.one_of_each_group,
        substring_dedup.without_repeats,
        lambda d: decontaminate.clean_documents(d, bench),
        lambda d: quality.accepted_documents(d, marks),
    ):
        out = stage(wide)
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == (f"{c}:{r.doc_id}" if r.doc_id is not None else c) for r in rows for c in taken)
    coded = bpe.encode(wide, VOCABULARY)
    names = [c.lower() for c in coded.columns]
    assert len(set(names)) == len(names) == len(wide.columns) + 2 and coded.columns[: len(wide.columns)] == wide.columns
    assert coded.count() == wide.count()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (1, 0)]
    found = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for n, m in ((50, 60), (500, 410), (7, 7)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: m // 2], rng.integers(0, 2**63, m - m // 2).astype(np.uint64)]))
        x, y = (np.frombuffer(simjoin.parity_bitmap(v), np.uint64)[None, :] for v in (a, b))
        width = min(x.shape[1], y.shape[1])
        bits = np.bitwise_count(simjoin._fold(x, width) ^ simjoin._fold(y, width)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_repeated_passages_are_found_and_cut(docs):
    spans = substring_dedup.repeated_spans(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in spans} == {2, 3, 6, 7}
    passage = prose(2, 60).split(" ")
    for r in spans:
        if r.doc_id in (6, 7):
            assert r.kept_doc_id == 5
            assert len(texts[r.doc_id][r.start : r.end].split()) >= substring_dedup.LEAST_WORDS
            assert set(texts[r.doc_id][r.start : r.end].split()) & set(passage)
    cut = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect() if r.doc_id is not None}
    assert 2 not in cut and cut[1].text == texts[1] and cut[5].text == texts[5]
    assert " ".join(passage) not in cut[6].text and cut[6].n_chars == len(cut[6].text)
    assert cut[8].text is None and cut[9].text == "" and substring_dedup.without_repeats(docs).schema == docs.schema


def test_lines_are_hashed_once_and_short_ones_never(monkeypatch):
    import pyarrow as pa

    long = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((20, 21, 40, 20))]
    texts = ["two words\n" + long[0] + "\none two three four five six", long[1] + "\n" + long[0], "", "\n\n", long[2] + " \n a\n" + long[3]]
    hashed = []
    real = substring_dedup.shingle_hashes
    monkeypatch.setattr(substring_dedup, "shingle_hashes", lambda words, at: (hashed.extend(np.diff(at).tolist()), real(words, at))[1])
    column = pa.array(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), column], names=["key", "doc_id", "text"])
    lines = next(substring_dedup._occurrences(iter([batch])))
    assert hashed == [20, 21, 20, 40, 20]
    assert lines.column("doc_id").to_pylist() == [0, 1, 1, 4, 4]
    sids, bits, bands = (lines.column(c).to_pylist() for c in ("sid", "bits", "bands"))
    assert sids[0] == sids[2] and bits[2] is None and bands[2] is None
    for p, text in ((0, long[0]), (1, long[1]), (3, long[2]), (4, long[3])):
        (values,) = textops.shingle_sets(*textops.buffers(pa.array([text])))
        assert sids[p] == textops.set_id(values) and bits[p] == simjoin.parity_bitmap(values)
        assert bands[p] == substring_dedup.band_keys(values, np.array([0, len(values)])).tobytes()
    posted = list(substring_dedup._postings(1)(iter([lines.filter(pa.array([b is not None for b in bands]))])))
    rows = np.frombuffer(posted[0].column("payload")[0].as_py(), simjoin.POSTING)
    assert hashed == [20, 21, 20, 40, 20] and len(rows) == 4 * substring_dedup.BANDS and set(rows["sid"].tolist()) == set(sids)


def test_short_phrases_of_many_documents_are_no_passage(spark):
    vocabulary = [f"w{k}" for k in range(500)]
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    vocabulary = [vocabulary[k] for k in np.argsort(word_hashes(data, np.array([0, len(data)]))[0])]
    # phrases of seven words; each begins with the least hash around it
    more = iter(vocabulary[20:])
    phrases = [" ".join([vocabulary[i], *(next(more) for _ in range(6))]) for i in range(6)]
    other = lambda: " ".join(next(more) for _ in range(12))
    texts = {i: f"{other()} {p} {vocabulary[10]} {other()}" for i, p in enumerate(phrases)}
    texts[9] = " ".join([other(), *phrases, vocabulary[11], other()])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert substring_dedup.repeated_passages(frame).collect() == []


def brute_passages(texts: dict) -> set:
    """``(doc, first word, one past the last, kept doc)`` of the repeated runs of LEAST_WORDS words."""
    least, first, out = substring_dedup.LEAST_WORDS, {}, set()
    for doc in sorted(texts):
        words, run = WORD.findall(texts[doc].translate(LOWER)), None
        for at in range(len(words) - least + 1):
            kept = first.setdefault(tuple(words[at : at + least]), (doc, at))
            if kept == (doc, at) or (kept[0] == doc and kept[1] + least > at):
                run = None
            elif run and run[1] == at + least - 1 and (run[2], run[3]) == (kept[0], kept[1] - 1):
                out.discard((doc, run[0], run[1], run[2]))
                run = (run[0], at + least, *kept)
                out.add((doc, run[0], run[1], run[2]))
            else:
                run = (at, at + least, *kept)
                out.add((doc, at, at + least, kept[0]))
    return out


def test_passages_of_all_lengths_equal_brute_force(spark):
    texts = {}
    for n in range(18, 61):
        passage = prose(5000 + n, n)[:-1]
        texts[n] = f"{prose(6000 + n, 30)} {passage} {prose(7000 + n, 9)}"
        texts[100 + n] = f"{prose(8000 + n, n - 18)} {passage}\n{prose(9000 + n, 25)}"
    # short phrases of different documents are no passage
    texts[200] = " ".join(" ".join(texts[n].split(" ")[3:12]) for n in range(18, 30))
    # one source runs on after another, and words that repeat themselves
    texts[201] = " ".join(texts[40].split(" ")[5:40] + texts[50].split(" ")[20:60])
    texts[202], texts[203], texts[204] = "ha " * 100, "so it goes " * 30, "é ha " * 3 + "ha " * 41
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set()
    for doc, a, b, kept in brute_passages(texts):
        places = [m.span() for m in WORD.finditer(texts[doc])]
        want.add((doc, places[a][0], places[b - 1][1], kept))
    found = {(r.doc_id, r.start, r.end, r.kept_doc_id) for r in substring_dedup.repeated_passages(frame).collect()}
    assert found == want
    assert {100 + n for n in range(20, 61)} < {r[0] for r in found} and not {118, 119, 200} & {r[0] for r in found}


def test_empty_tables(no_docs):
    assert ngram_join.ngram_jaccard_components(no_docs).count() == 0
    assert substring_dedup.repeated_spans(no_docs).count() == 0
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_tiles_with_much_the_same_members_are_one_group(spark):
    rng = np.random.default_rng(4)
    rows, passages = [], 30
    for sid in range(400):
        # the elements of one passage make 20 tiles; a prefix may end inside a passage
        for passage in sorted(rng.choice(passages, 4, replace=False))[:3]:
            for element in range(int(rng.integers(12, 21))):
                rows.append((int(passage * 100 + element), sid, 25, 300, 320 + int(element), 0))
    members = spark.createDataFrame(rows, "tok long, sid long, band int, size int, most int, rare int")
    grouped = simjoin.tile_groups(members)
    assert grouped.columns == ["tok", "sid", "band", "size", "most"]
    cells = {(r.tok, r.sid): r.most for r in grouped.collect()}
    tiles, groups = {}, {}
    for tok, sid, _, _, most, _ in rows:
        tiles.setdefault(tok, {})[sid] = most
    for (group, sid), most in cells.items():
        groups.setdefault(group, {})[sid] = most
    # the members of each tile, with bounds no tighter, are together in a group
    for own in tiles.values():
        assert any(all(g.get(sid, -1) >= most for sid, most in own.items()) for g in groups.values())
    assert 8 * len(cells) < len(rows)
