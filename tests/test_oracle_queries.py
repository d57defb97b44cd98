"""Every registered query equals its DuckDB oracle (sf0.001 here; the
driver checks sf0.01), plus the flagship smoke entry."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_an_oracle():
    # the optional subpackage tests its queries without SQL against brute force
    assert set(entry._retail_queries()) == set(entry._retail_oracle())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    df = entry.queries()[name](spark, sf_small)
    ok, message = compare(df, con, entry.oracle_sql()[name])
    assert ok, f"{name}: {message}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "customer_id", "recency_days", "frequency", "monetary",
        "r_score", "f_score", "m_score", "segment",
    ]
