from __future__ import annotations

import random

import pyarrow as pa
import pytest

import public_tokenizers
from ledgerlens.llm import token_counts
from ledgerlens.llm.textops import chunks

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u200b", "\u3000", "'s", "'", "'VE", "\u00e9", "e\u0301", "\u0301",
         "\u03a3", "\u0130", "\u00df", "\ufb01", "\u4e2d", "\U0001f600", "1", "23", "\u0663", "\u00bd", "!", "?!", "<|endoftext|>", "<|startoftext|>",
         "<|ENDOFTEXT|>", "<|", "|>", "_", "\u212b", "\u1112\u1161\u11ab", "The", "quick", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_librarys_on_odd_texts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["ab" * 3000, "<|endoftext|>" * 50, "\u00e9" * 500]
    merges = token_counts.Merges(PATH)
    got = [n for _, _, data, offsets in chunks(pa.array(texts)) for n in token_counts.text_counts(data, offsets, merges, {})]
    assert got == [library(t) for t in texts]


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 3)
    texts = ["one two three four five six one two", "seven eight one nine", "ten"]
    merges, cache = token_counts.Merges(PATH), {}
    got = [n for _, _, data, offsets in chunks(pa.array(texts)) for n in token_counts.text_counts(data, offsets, merges, cache)]
    assert got == [library(t) for t in texts] and len(cache) <= 3


def test_other_kinds_of_files_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["model"]["byte_fallback"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.Merges(str(tmp_path / "other.json"))


def test_every_row_is_counted(docs, no_docs, library):
    got = token_counts.count_tokens(docs, PATH, limit=100).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.collect()]
    assert sorted((tuple(r[:3]) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(no_docs, PATH).count() == 0
