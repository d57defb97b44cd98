"""Landing lines: cells by the plain way and by the grammar, blanks, the split index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import normalise as N
from ledgerlens.operators import ingest
from ledgerlens.sources import landing

LINES = [
    "a,b,c,d,e,f,g,h",
    ' a , b,c,,e,"",g,h ',
    '"","","","","","","",""',
    ",,,,,,,",
    "a,b,c",
    "a,b,c,d,e,f,g,h,i",
    "a,b,c,d,e,f,g,",
    'a,"b,c",c,d,e,f,g,h',
    'a,"b ""x"" c",c,d,e,f,g,h',
    'a,""b,c,d,e,f,g,h',
    'a,"" ,c,d,e,f,g,h',
    'a,b"c,c,d,e,f,g,h',
    'a,b,c,d,e,f,g,"h',
    r"a,b\,c,d,e,f,g,h",
    r'a,"b\"",c,d,e,f,g,h',
    "#a,b,c,d,e,f,g,h",
    "é,ü ,c,d,e,f, ,h",
    " ",
    "",
]


def test_plain_lines_have_the_cells_of_the_grammar(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)] + [(99, None)], "i int, value string")
    full = landing._record({})
    plain = lines.withColumn("_ln_cells", landing._plain_cells())
    got = plain.select("i", landing._plain_record(full).alias("r")).select("i", "r.*").orderBy("i").collect()
    assert got == lines.select("i", full.alias("r")).select("i", "r.*").orderBy("i").collect()
    by_parts = plain.where(F.size("_ln_cells") == len(ingest.RAW_HEADERS)).count()
    assert by_parts == 8


@pytest.mark.parametrize("strip, blanks", [(N.strip_text, N.PY_WHITESPACE), (N.strip_number_text, N.PY_FLOAT_WHITESPACE)])
def test_cells_are_stripped_as_by_the_whole_set(spark, strip, blanks):
    ends = ["", " ", "  ", "\t", "\x1c", " ", "  ", "　 ", "\n", "\x00"]
    texts = [f"{a}{m}{b}" for a in ends for m in ("", "x", "x y", "12.5", "é") for b in ends]

    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"))
    assert [(r.t, r.s) for r in frame.collect()] == [(t, t.strip(blanks)) for t in texts]


def test_the_split_index_scans_the_lines_once(spark, tmp_path):
    for name, rows in (("a.csv", 3), ("b.csv", 0), ("c.csv", 2)):
        (tmp_path / name).write_text("\n".join(["h", *["x"] * rows]) + "\n")
    index = landing.split_index(landing.tag_rows(spark.read.text(str(tmp_path))), headers=True)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert [(r._ln_before, r._ln_header) for r in index.orderBy("_ln_f").collect()] == [(0, "h"), (3, "h"), (3, "h")]
