"""Python workers give freed memory back, and take texts out of Arrow in small parts."""

from __future__ import annotations

import pyarrow as pa
import pytest

from ledgerlens.llm import decontaminate, quality, workers

BATCHES = [pa.RecordBatch.from_arrays([pa.array([i, i + 1])], names=["x"]) for i in range(3)]


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda least=0.0: calls.append(least))
    lean = workers.released(lambda batches: (b.slice(1) for b in batches))
    assert [b.to_pylist() for b in lean(iter(BATCHES))] == [b.slice(1).to_pylist() for b in BATCHES]
    assert calls[-1] == 0.0 and calls.count(0.0) == 1
    calls.clear()
    started = lean(iter(BATCHES))
    next(started)
    started.close()  # a limit ends the task early
    assert calls == [0.0]

    def fails(batches):
        yield next(batches)
        raise ValueError("no")

    calls.clear()
    with pytest.raises(ValueError):
        list(workers.released(fails)(iter(BATCHES)))
    assert calls[-1] == 0.0


def test_groups_keep_their_arguments():
    table = pa.table({"x": [1]})
    assert workers.released_group(lambda key, t: t)((1,), table) is table
    assert workers.released_pair(lambda key, a, b: b)((1,), None, table) is table


def test_texts_are_taken_out_in_small_parts(monkeypatch):
    texts = [None if i % 7 == 3 else f"words of document {i} " + ("which is hidden" if i % 5 == 0 else "and more") for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], names=["0", "1"])
    sizes, real = [], decontaminate.find_items
    monkeypatch.setattr(decontaminate, "find_items", lambda t, items: (sizes.append(len(t)), real(t, items))[1])
    monkeypatch.setattr(decontaminate, "ROWS", 8)
    (kept,) = decontaminate._drop_hit([1], ["which is hidden"], 1)(iter([batch]))
    assert max(sizes) == 8 and sum(sizes) == 50
    assert kept.column(0).to_pylist() == [i for i in range(50) if i % 7 == 3 or i % 5]
    found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_id", "text"])
    (rows,) = decontaminate._scan([1], ["which is hidden"])(iter([found]))
    assert rows.column(0).to_pylist() == [i for i in range(50) if i % 7 != 3 and i % 5 == 0]


def test_a_text_is_sent_once(spark):
    docs = spark.createDataFrame([(1, "a clean text of words"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a passage of the benchmark")], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, bench)
    assert "_text" not in clean._jdf.queryExecution().analyzed().toString()
    assert sorted(clean.collect()) == sorted(docs.collect())


def test_the_driver_gives_its_sample_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "give_back", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, f"text number {i}", "host") for i in range(20)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 20 and calls
