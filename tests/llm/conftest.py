from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # further columns with names that operators use inside
        T.StructField("key", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)
WORDS = "amber bridge candle delta ember forest garden harbor island jungle kettle ladder marble needle orchid pepper quartz ribbon saddle temple".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + "."


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(2, 60)
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 90)),
        (5, prose(4, 40) + " " + passage + " " + prose(5, 40)), (6, prose(6, 50) + " " + passage + " " + prose(7, 30)),
        (7, prose(8, 30) + "\n" + passage + "\n" + prose(9, 30)),
        (8, None), (9, ""), (10, " \n\t "), (11, "one two three"), (12, "One TWO three"), (13, "é" * 50 + " ñ ß 中文 😀"),
        (14, prose(10, 20000)), (4, prose(3, 90)), (None, prose(11, 50)), (None, None), (15, "12 34 ..."),
    ]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], "host" if k % 3 else None, len(t) if t is not None else None, "k", None, "b") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.where("false").write.parquet(path)
    return docs.sparkSession.read.parquet(path)
