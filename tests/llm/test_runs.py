from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerlens.llm import runs
from ledgerlens.llm.textops import mix


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) by comparing all words that lie q apart."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and e + q - s >= max(least, times * q):
                found.setdefault((s, e + q - s), q)
            s = max(e, s + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_digest(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, milli, digest(listed), digest(kept))


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            kinds = rng.choice([1, 2, 3, 20])
            words = [rng.randrange(kinds) for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(3)):
                a = rng.randrange(len(words) + 1)
                words[a : a + rng.randrange(1, 8)] *= rng.randrange(1, 8)
            texts.append(words)
        first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        symbols = mix(np.array([x for w in texts for x in w], np.uint64))
        begin, stop, period = runs.runs_of(symbols, first, least, times)
        want = [(s + first[d], length, q) for d, w in enumerate(texts) for s, length, q in sorted(brute_runs(w, least, times), key=lambda r: (r[0], r[2]))]
        assert list(zip(begin, stop - begin, period)) == want


def test_one_word_or_one_long_cycle_over_and_over():
    one = np.zeros(200_000, np.uint64)
    assert [c.tolist() for c in runs.runs_of(mix(one), np.array([0, len(one)]))] == [[0], [200_000], [1]]
    cycle = np.tile(np.arange(1, 3001, dtype=np.uint64), 20)
    assert [c.tolist() for c in runs.runs_of(mix(cycle), np.array([0, len(cycle)]))] == [[0], [60_000], [3000]]


def test_nested_and_touching_runs():
    words = "x x x x x x y " * 5 + "p q p q p q p q"
    symbols = mix(np.array([hash(w) % 1000 for w in words.split()], np.uint64))
    begin, stop, period = runs.runs_of(symbols, np.array([0, len(symbols)]))
    got = list(zip(begin.tolist(), (stop - begin).tolist(), period.tolist()))
    assert got == sorted(brute_runs(words.split()), key=lambda r: (r[0], r[2]))
    assert (0, 35, 7) in got and (35, 8, 2) in got


def _same(found, rows):
    key = lambda r: tuple((c is None, c) for c in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(rows, key=key)


def test_digests_of_every_row(docs, no_docs):
    _same(runs.run_digests(runs.periodic_runs(runs.with_cycles(docs))), [brute_digest(r.doc_id, r.text) for r in docs.collect()])
    assert runs.run_digests(runs.periodic_runs(runs.with_cycles(no_docs))).count() == 0


def test_digests_of_repetitive_texts(spark):
    rng = random.Random(9)
    rows = []
    for d in range(400):
        words = [rng.choice(["a", "A", "b", "c\u00e9"]) + rng.choice(["", "", ".", "1"]) for _ in range(rng.randrange(60))]
        if d % 3 == 0 and words:
            words = words[:5] * rng.randrange(1, 12) + words
        rows.append((d if d % 50 else None, rng.choice([" ", "\n", " \t "]).join(words) if d % 41 else None))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _same(runs.run_digests(runs.periodic_runs(runs.with_cycles(table))), [brute_digest(*r) for r in rows])


def test_collapsed_text_and_runs_are_given(spark):
    table = spark.createDataFrame([(1, "go go go go go go now"), (2, "a b a b a b a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(table).collect()}
    assert got[1].collapsed == "go now" and [tuple(r) for r in got[1].runs] == [(0, 6, 1)] and got[1].n_words == 7
    assert got[2].collapsed == "a b c" and [tuple(r) for r in got[2].runs] == [(0, 8, 2)]
