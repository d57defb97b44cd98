"""Sharding, fingerprints, language, scores, quality and contamination."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, imatch, langid, lm, quality, sharding

from .conftest import prose
from .test_sets import LOWER, WORD


def test_shards(docs, no_docs):
    placed, table = sharding.shard_documents(docs, shards=5)
    rows = placed.collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()
    )
    for shard in range(5):
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert table.count() == sharding.SLOTS
    assert sharding.shard_documents(no_docs)[0].count() == 0


@pytest.mark.parametrize("text", ["cast(id as string)", "'one and the same'", "if(id % 6 = 0, repeat('word ', 9), concat('text ', id))"])
@pytest.mark.parametrize("doc_id", ["if(id % 3 = 0, 7, id)", "cast(null as bigint)", "id"])
def test_shards_are_even_whatever_repeats(spark, doc_id, text):
    """A third of the rows, or all, on one id or none, with texts of their own or the same."""
    docs = spark.range(20000).selectExpr(f"{doc_id} AS doc_id", f"{text} AS text")
    placed = sharding.shard_documents(docs)[0]
    loads = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    sizes = [r.bytes for r in loads]
    assert len(loads) == 24 and sum(r.n for r in loads) == 20000
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 24
    assert all(r.last + 1 == r.slots == r.n for r in loads)
    assert {r.law for r in placed.select("law").distinct().collect()} == {"bytes"}


def test_rebalancing_moves_few_slots_and_evens_loads():
    rng = np.random.default_rng(0)
    loads = {s: int(x) for s, x in enumerate(rng.integers(1, 1000, 512))}
    first = sharding.plan_map(loads, 8, 512)
    grown = sharding.rebalance(first, loads, 9)
    sizes = Counter()
    for slot, shard in enumerate(grown):
        sizes[shard] += loads[slot]
    assert max(sizes.values()) - min(sizes.values()) < 2000
    moved = [s for s in range(512) if first[s] != grown[s]]
    assert len(moved) < 512 / 9 * 2 and sum(grown[s] == 8 for s in moved) > len(moved) * 0.8
    assert set(sharding.rebalance(first, loads, 6)) == set(range(6))


def test_fingerprints(docs, no_docs):
    found = imatch.fingerprint_documents(docs).collect()
    texts = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, text) in enumerate(texts):
        after, cut = texts[(k + 1) % len(texts)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in found]
    assert sorted(got) == sorted(want)
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint != "" and by[9].fingerprint == by[8].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert by[4].near_edited > by[4].near_next
    assert imatch.fingerprint_documents(no_docs).count() == 0


@pytest.mark.parametrize("ids", [[7], [5, 5, 5], list(range(0, 5000, 7)), [1, 2, 10**15, -(10**15)]])
def test_next_row_by_descending_key(spark, monkeypatch, ids):
    monkeypatch.setattr(imatch, "ROWS_A_BUCKET", 16)
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "key long, text string")
    found = sorted((r.key, r.next_text) for r in imatch.with_next(frame, ["text"], "key", "text").collect())
    order = sorted(ids, reverse=True)
    assert found == sorted((i, f"t{order[(k + 1) % len(order)]}") for k, i in enumerate(order))


def test_language_id(spark, docs, no_docs):
    import random

    rng, rows = random.Random(2), []
    sounds = {"aa": ["bra", "ka", "zo", "lum"], "bb": ["ti", "ré", "que", "sno"]}
    for i in range(300):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(30)), lang))
    rows += [(1000, None, "aa"), (1001, "123 !", "bb"), (1002, "", None)]
    found = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == ("und" if r.doc_id >= 1000 else truth[r.doc_id]) and 0 <= r.score <= 1
    assert langid.identify_languages(docs).count() == docs.count()
    assert langid.identify_languages(no_docs).count() == 0


def test_language_does_not_depend_on_the_texts_around():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)

    def scores(texts):
        n = len(texts)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array(texts, pa.string())], names=["doc_id", "held_out", "text"]
        )
        return [(r["lang_pred"], round(r["score"], 6)) for out in langid._predict(model)([batch]) for r in out.to_pylist()]

    texts = [prose(i, 12) for i in range(4)]
    alone = [scores([t])[0] for t in texts]
    for junk in ("12 34 " * 2000, "...", "7", "", None):
        mixed = scores([x for t in texts for x in (t, junk)])
        assert mixed[::2] == alone and set(mixed[1::2]) == {(langid.UNKNOWN, 0.0)}


def test_lm_scores_equal_brute_force(docs, no_docs, monkeypatch):
    learned = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells: learned.setdefault("w", learn(cells)))
    found = lm.score_documents(docs).collect()
    rows = [(r.doc_id, [*WORD.findall((r.text or "").translate(LOWER)), "\0end"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words, pairs, starts = Counter(), Counter(), 0
    for i, tokens in rows:
        if not held(i):
            words.update(tokens)
            pairs.update(zip(["\0begin", *tokens], tokens))
            starts += 1
    n, v, want = sum(words.values()), len(words), []
    for i, tokens in rows:
        score = 0.0
        for before, own in zip(["\0begin", *tokens], tokens):
            c = starts if before == "\0begin" else words[before]
            w = learned["w"][int(lm.context_bucket(np.array([c]))[0])]
            score += math.log10(w[0] * (pairs[before, own] / c if c else 0) + w[1] * words[own] / n + w[2] / (v + 1))
        base = sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens)
        want.append((i is None, i or 0, held(i), len(tokens), sum(words[t] > 0 for t in tokens), n, base, score))
    got = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], rel=1e-9)
    assert len(got) == len(want) and lm.score_documents(no_docs).count() == 0


def test_em_weights_are_a_mixture():
    cells = {(5 * lm.STEPS + 60) * lm.STEPS + 30: 90, (5 * lm.STEPS + 0) * lm.STEPS + 30: 10}
    weights = lm.learn_weights(cells)
    assert weights.sum(1) == pytest.approx(np.ones(lm.CONTEXTS)) and weights[5, 0] > 0.8


def test_quality(spark, docs, no_docs):
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = prose(i, 60) if kind else "@@ ## $$ " * 40
        rows.append((i, text + (" foulword" if kind == 1 else ""), f"site{i % 3}", "en"))
        if i < 300:
            labels.append((i, int(kind != 0), int(kind == 1)))
    frame = spark.createDataFrame(rows + [(900, None, None, None), (901, "", "rare", "en")], "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.keep for r in quality.classify(frame, marks).collect()}
    assert all(found[i] == (i % 4 in (2, 3)) for i in range(400)) and len(found) == 402
    kept = quality.accepted_documents(frame, marks)
    assert kept.schema == frame.schema and kept.count() == sum(found.values())
    assert quality.classify(docs, marks).count() == docs.count()
    assert quality.classify(no_docs, marks).count() == 0
    assert quality.classify(frame, marks.where("false")).count() == 402


def _edit_distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contamination_equals_brute_force(spark, docs, no_docs, monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)  # several blocks of items
    rng = random.Random(4)
    items = [(i, prose(100 + i, 14)) for i in range(6)] + [(50, "tiny"), (51, None), (52, "  ")]
    rows = []
    for i in range(80):
        text = list(items[i % 6][1].upper() if i % 2 else items[i % 6][1])
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((i, prose(200 + i, 20) + " " + "".join(text) + "\n" + prose(300 + i, 20)))
    rows += [(90, None), (91, ""), (92, "a tiny one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated_passages(frame, bench).collect()}
    plain = lambda t: t.translate(LOWER).replace("\n", " ")
    for d, text in rows:
        for i, item in items[:6]:
            want = _edit_distance(plain(item), plain(text or ""))
            assert found.get((d, i)) == (want if want <= int(len(item) * decontaminate.EDIT_SHARE) else None)
    assert {k for k in found if k[1] >= 50} == {(92, 50)}
    clean = decontaminate.clean_documents(frame, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(80)) - {d for d, _ in found} | {90, 91})
    assert decontaminate.clean_documents(docs, bench).schema == docs.schema
    assert decontaminate.contaminated_passages(no_docs, bench).count() == 0
    assert decontaminate.contaminated_passages(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("length", [20, 24, 25, 29, 30, 37, 38, 39, 40, 49])
def test_edits_within_the_budget_of_any_length(length):
    """The budget is the share of the length, or the most that leaves the bound positive."""
    import random

    rng = random.Random(length)
    q = decontaminate.Q
    budget = min(int(length * decontaminate.EDIT_SHARE), (length - q) // q)
    assert budget >= 1
    for _ in range(40):
        item = "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(length - 2)).join("xy")
        text = list(item)
        for _ in range(rng.randrange(budget + 2)):
            text[rng.randrange(len(text))] = rng.choice(["", "z", "zz"])
        whole = prose(rng.randrange(99), 9) + " " + "".join(text) + " " + prose(rng.randrange(99), 9)
        want = _edit_distance(item, whole)
        found = decontaminate.find_items([whole], decontaminate.Items([1], [item]))
        assert [f[4] for f in found] == ([want] if want <= budget else [])


def test_alignments_of_a_batch_equal_brute_force(monkeypatch):
    import random

    rng = random.Random(8)
    jobs, wanted, batches = [], [], []
    for _ in range(120):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(10, 40)))
        text = list(item)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = rng.choice(["", "z", "ab"])
        edits = rng.randrange(4)
        around = ["".join(rng.choice("abc") for _ in range(rng.randrange(edits + 1))) for _ in range(2)]
        region = "".join(text).join(around)
        jobs.append((decontaminate.plain(item), decontaminate.plain(region), edits))
        wanted.append((_edit_distance(item, region), item, region))
    real = decontaminate._aligned
    monkeypatch.setattr(decontaminate, "_aligned", lambda *a: (batches.append(len(a[1])), real(*a))[1])
    found = decontaminate.alignments(jobs)
    assert len(batches) < 5
    assert found == [decontaminate.alignment(*job) for job in jobs]
    for (_, _, edits), (want, item, region), place in zip(jobs, wanted, found):
        assert (place is not None) == (want <= edits)
        if place:
            assert place[0] == want == _edit_distance(item, region[place[1] : place[2]])


def test_short_items_are_whole_words():
    items = decontaminate.Items([1, 2], ["yes", "(ok)"])
    texts = ["yesterday", "eyes", "Yes.", "oh yes", "a(ok)b", "yes yes", None, ""]
    assert [f[:4] for f in decontaminate.find_items(texts, items)] == [
        (2, 0, 0, 3), (3, 0, 3, 6), (4, 1, 1, 5), (5, 0, 0, 3), (5, 0, 4, 7),
    ]


def test_repetitive_texts_take_little_memory():
    import tracemalloc

    items = decontaminate.Items([1, 2], ["a" * 300, "ab" * 100])
    texts = ["a" * 20000, "ab" * 3000 + "a" * 290, "a" * 299 + "b" + "a" * 299]
    tracemalloc.start()
    found = decontaminate.find_items(texts, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    by_text = Counter((d, i, e) for d, i, _, _, e in found)
    assert by_text[0, 0, 0] == 20000 // 300 and by_text[1, 1, 0] == 30
    # runs of 290 and 299 letters are within the 24 edits of 300
    assert {(d, i) for d, i, *_ in found} == {(0, 0), (1, 0), (1, 1), (2, 0)}
    for d in range(3):
        spans = sorted((a, b, i) for t, i, a, b, _ in found if t == d)
        assert all(b <= c for (_, b, i), (c, _, j) in zip(spans, spans[1:]) if i == j)


def _xx(parts: list[int] | str) -> int:
    """Spark's xxhash64 of a text, or of longs in a row, as an unsigned number."""
    if isinstance(parts, str):
        return xxhash.xxh64_intdigest(parts.encode(), 42)
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest((p % 2**64).to_bytes(8, "little"), seed)
    return seed


def _brute_fingerprint(terms: set, band: set) -> dict[int, int]:
    """The signature of each subset that the text meets."""
    out = {}
    hashes = sorted(_xx(t) for t in (terms & band or terms))
    for subset in {h % 32 for h in hashes}:
        levels = {}
        for h in hashes:
            if h % 32 == subset:
                bits = (h >> 5) % 2**23 + 2**23
                levels.setdefault(bits & -bits, []).append((subset << 58) + ((2**24 - (bits & -bits)) << 33) + (h >> 31))
        thinnest = sorted(levels[max(levels)])
        sign = _xx([thinnest[0]])
        for v in thinnest[1:]:
            sign = _xx([sign, v])
        out[subset] = sign // 32 * 32 + subset
    return out


def test_fingerprints_equal_brute_force(spark):
    """Band, nested subsets, hashes and likenesses; ids apart, so that the order is given."""
    import random

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(6000)]
    texts = {}
    for i in range(300):
        n = rng.choice([0, 3, 40, 200])
        texts[i * 7 - 400] = " ".join(vocabulary[int(6000 * rng.random() ** 2)] for _ in range(n)) if i % 50 else None
    texts[5000] = texts[5001] = "Only, here: Words! only"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    terms = lambda t: {x for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x}
    buckets = Counter(b for t in texts.values() for b in {_xx(w) % imatch.TERM_BUCKETS for w in terms(t or "")})
    most = max(imatch.MIN_DOCUMENTS, int(imatch.MAX_SHARE * len(texts)))
    band = {w for t in texts.values() for w in terms(t or "") if imatch.MIN_DOCUMENTS <= buckets[_xx(w) % imatch.TERM_BUCKETS] <= most}
    assert 100 < len(band) < 6000
    written = lambda f: "-".join(f"{f[k]:x}" for k in sorted(f))

    def alike(a, b):
        either = a.keys() | b.keys()
        return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 1.0

    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in imatch.fingerprint_documents(frame).collect()}
    assert len(found) == len(texts)
    for i, after in zip(order, order[1:] + order[:1]):
        own, following = texts[i] or "", texts[after] or ""
        tail = len(own) // 3
        edited = own[: len(own) - tail] + following[:tail]
        a, b, c = (_brute_fingerprint(terms(t), {w for w in terms(t) if imatch.MIN_DOCUMENTS <= buckets[_xx(w) % imatch.TERM_BUCKETS] <= most}) for t in (own, edited, following))
        r = found[i]
        assert (r.fingerprint, r.edited_fingerprint) == (written(a), written(b))
        assert (r.near_edited, r.near_next) == pytest.approx((alike(a, b), alike(a, c)))


def test_site_posteriors_equal_brute_force(spark):
    """Hosts shrink to the global rate, paths to their host's; null hosts and sites of one document included."""
    import random

    rng = random.Random(8)
    rows = []
    for host, n, low in (("hot", 400, -3.0), ("bad", 60, 2.0), ("mixed", 90, 0.0), (None, 30, 1.0), ("rare", 1, 4.0)):
        for k in range(n):
            blank = k % 11 == 10
            rows.append((host, f"{host}/{k % 3}", *((None, None) if blank else (low + rng.gauss(0, 1), -low + rng.gauss(0, 1)))))
    found = {(r._host, r._path): r for r in quality._posteriors(spark.createDataFrame(rows, "host string, path string, bad double, toxic double")).collect()}
    rate = lambda x: 1 / (1 + math.exp(-x))
    for k, kind in enumerate(("bad", "toxic"), 2):
        paths, hosts = {}, {}
        for r in rows:
            if r[k] is not None:
                paths.setdefault((r[0], r[1]), []).append(rate(r[k]))
                hosts.setdefault(r[0], []).append(rate(r[k]))
        every = [x for v in hosts.values() for x in v]
        mean = (sum(every) + 1) / (len(every) + 2)

        def strength(groups):
            spread = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups)
            between = max(1e-9, (spread - (len(groups) - 1) * mean * (1 - mean)) / len(every))
            return min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, mean * (1 - mean) / between - 1))

        odds = lambda p: math.log(p / (1 - p))
        s_host, s_path = strength(list(hosts.values())), strength(list(paths.values()))
        assert found.keys() == paths.keys()
        for (host, path), own in paths.items():
            above = (sum(hosts[host]) + s_host * mean) / (len(hosts[host]) + s_host)
            want = (sum(own) + s_path * above) / (len(own) + s_path)
            assert found[host, path][f"site_{kind}"] == pytest.approx(odds(want) - odds(mean))


def test_quality_on_documents_whose_labels_are_hidden(spark, sf_oracle):
    """Learn from half of the labels; of the other half few documents are judged wrong."""
    documents, labels = (spark.read.parquet(f"{sf_oracle}/{t}.parquet") for t in ("documents", "labels"))
    shown = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    keep = quality.classify(documents, labels.where(shown)).select("doc_id", "keep")
    hidden = labels.where(~shown).select("doc_id", (F.expr("quality = 0 OR toxic = 1")).alias("bad")).where("bad is not null")
    counts = {(r.bad, r.keep): r["count"] for r in hidden.join(keep, "doc_id").groupBy("bad", "keep").count().collect()}
    bad, good = (sum(n for (b, _), n in counts.items() if b is kind) for kind in (True, False))
    assert bad > 20 and good > 100
    assert counts.get((False, True), 0) >= 0.97 * good and counts.get((True, False), 0) >= 0.8 * bad
