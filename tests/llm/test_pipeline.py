"""The pipeline's stages on a small corpus, against what each must keep."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from ledgerlens.llm import bpe
from ledgerlens.llm.queries import VOCABULARY, queries
from ledgerlens.session import materialize

from .conftest import prose
from .test_sets import brute_components


def test_pipeline_keeps_clean_documents_and_drops_the_others(spark, tmp_path):
    rng, rows, labels = random.Random(1), [], []
    item = prose(900, 30)
    passage = prose(901, 70)
    for i in range(240):
        text = prose(i, 80)
        if i % 8 == 0:
            text = "%% && ## " * 30
        elif i % 8 == 1:
            text += " foulword"
        elif i % 8 == 2 and i > 8:
            words = prose(2, 80).split(" ")
            words[rng.randrange(80)] = "edit"
            text = " ".join(words)
        elif i % 8 == 3 and i < 100:
            text += "\n" + passage + "\n" + prose(1000 + i, 10)
        elif i % 8 == 4 and i < 100:
            text += " " + item
        rows.append((i, text, "en", f"site{i % 5}", len(text)))
        labels.append((i, int(i % 8 != 0), int(i % 8 == 1)))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    texts = {r[0]: r[1] for r in rows}
    groups = brute_components({i: t for i, t in texts.items() if i % 8 > 1})
    # a document with the item is dropped, unless the repeated passage was cut before
    leaky = {i for i in range(100) if i % 8 == 4}
    expected = {i for i, least in groups.items() if i == least} - leaky
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(out) - leaky == expected and 4 not in out
    vocab = bpe.vocabulary(VOCABULARY)
    for i, r in out.items():
        assert bpe.decode(np.frombuffer(r.ids, "<u4").astype(np.int64), vocab).tobytes() == r.text.encode()
        assert r.n_chars == len(r.text) and r.n_tokens * 4 == len(r.ids)
        assert item not in r.text
        if i < 100 and i % 8 == 3 and i > 3:
            assert passage not in r.text
        elif i >= 100 or i % 8 != 4:
            assert r.text == texts[i]
    assert corpus_pipeline.STAGES[0][0] == "quality classifier" and "pipeline" in queries()


def test_no_kept_document_holds_a_part_of_an_item(spark, tmp_path):
    """An item that leaked into several documents is gone from all that stay."""
    item, rows = prose(77, 45)[:-1], []
    for i in range(12):
        text = prose(100 + i, 40)
        rows.append((i, f"{text} {item} {prose(200 + i, 30)}" if i % 2 else text, "en", "site", 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name.replace(" ", "-").lower())
    out = {r.doc_id: r.text for r in docs.collect()}
    words = item.split(" ")
    assert set(out) == set(range(12)) - {1}
    for text in out.values():
        assert not any(" ".join(words[k : k + 8]) in text for k in range(len(words) - 7))
