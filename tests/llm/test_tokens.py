"""Byte-level BPE and packing: round trips and the reference encoder."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from ledgerlens.llm import bpe, packing
from ledgerlens.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_encoder(encoder):
    rng = random.Random(3)
    parts = ["the", "'", "'s", "'re", "'T", " ", "  ", "\n", "\r\n", " ", "　", "é", "1", "٣", "?!", "😀", "中文", "can't", "x" * 40, "ab" * 30, "tionontion", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["", " ", "'ll'"]
    data, offsets = bpe.buffers(pa.array(texts))
    vocab = bpe.vocabulary(VOCABULARY)
    ids, at = bpe.encode_corpus(data, offsets, vocab)
    for d, text in enumerate(texts):
        own = ids[at[d] : at[d + 1]]
        assert own.tolist() == encoder.encode_ordinary(text)
        assert bpe.decode(own, vocab).tobytes() == text.encode()


def test_short_pieces_take_as_many_rounds_as_they_have_bytes(monkeypatch):
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abcdehinorst é") for _ in range(rng.randrange(1, 45))).encode() for _ in range(3000)}
    pieces |= {b"a" * n for n in range(1, 45)}
    ordered = sorted(pieces)
    data = np.frombuffer(b"".join(ordered), np.uint8)
    lengths = np.array([len(p) for p in ordered])
    starts = np.cumsum(lengths) - lengths
    vocab = bpe.vocabulary(VOCABULARY)
    ids, at = bpe.encode_pieces(data, starts, lengths, vocab)
    want, want_at = bpe.replay(data, starts, lengths, vocab)
    assert ids.tolist() == want.tolist() and at.tolist() == want_at.tolist()

    calls = []
    real = vocab.rank
    monkeypatch.setattr(vocab, "rank", lambda *a: (calls.append(1), real(*a))[1])
    words = " ".join(p.decode()[:6] for p in ordered if p.isascii())
    bpe.encode_corpus(np.frombuffer(words.encode(), np.uint8), np.array([0, len(words)]), vocab)
    assert len(calls) < 200


def test_digests_of_all_rows(docs, no_docs, encoder):
    found = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, VOCABULARY).collect())
    want = []
    for r in docs.collect():
        ids = encoder.encode_ordinary(r.text or "")
        sums = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (r.text or "").encode())]
        want.append((r.doc_id or -1, len(ids), *sums))
    assert found == sorted(want)
    assert bpe.round_trip_digests(no_docs, VOCABULARY).count() == 0


def test_encode_and_decode_columns(docs):
    coded = bpe.encode(docs, VOCABULARY)
    assert coded.columns == [*docs.columns, "n_tokens", "ids"]
    for r in bpe.decode_column(coded, VOCABULARY).collect():
        assert r.decoded == (r.text or "") and len(r.ids) == 4 * r.n_tokens


def test_packing_is_lossless(docs, no_docs, encoder):
    packed = packing.pack_documents(docs, VOCABULARY, length=128)
    back: dict = {}
    for r in packing.unpack_documents(packed).collect():
        back.setdefault(r.doc_id, {}).setdefault(r.number, []).append(np.frombuffer(r.ids, "<u2").tolist())
    for r in docs.collect():
        if r.doc_id in (None, 4):
            continue
        assert sum((back[r.doc_id][k][0] for k in sorted(back[r.doc_id])), []) == [*encoder.encode_ordinary(r.text or ""), packing.END_ID]
    assert len(back[4][0]) == 2  # a repeated row is packed twice
    for r in packed.collect():
        positions = np.frombuffer(r.position_ids, "<u2")
        assert r.cu_seqlens[-1] == r.n_tokens <= 128 and len(positions) == 128
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_best_fit_takes_the_fullest_row():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 65) for _ in range(500)]
    rows = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(500))
    assert all(sum(sizes[i] for i in r) <= 64 for r in rows)
    free: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - size)
        else:
            free.append(64 - size)
    assert len(rows) == len(free)
