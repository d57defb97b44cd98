"""A stored sales rollup that new lines are merged into, read by KPIs, trend, markets and RFM.

The state has one row per (day, country, invoice, customer) of the valid sales:
revenue in cents and the last timestamp.  Sums and maxima merge, so the state of
all lines is that of every batch put together, whatever the order:

    <root>/versions/<id>/state   the segment of one batch, or several merged into one
    <root>/commits/...           a commit names the segments and the batches in them

``merge_batch`` aggregates only the new lines and commits one more segment (see
``versions``): a merge that fails or is killed changes nothing, and a batch that
is merged already is skipped, so a load can be run again.  With ``MOST_SEGMENTS``
segments they are merged into one.  One writer at a time; readers need no lock.

Readers aggregate the segments as they stand.  Date and country filters reach the
Parquet scan, and segments are laid out by day, so a short range opens few files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import DateLike, date_range
from ..functions.numeric import cents
from ..operators import rfm, sales
from ..session import delete_path
from .versions import Version, _commit_path, committed, current, history, publish

KEYS = ["day", "country", "invoice_no", "customer_id"]
MOST_SEGMENTS = 16


def sales_state(lines: DataFrame) -> DataFrame:
    """The state of the valid sales among ``lines``; lines without a timestamp are in no range and stay out."""
    valid = lines.where("is_valid_sale AND invoice_timestamp IS NOT NULL").withColumn("day", F.to_date("invoice_timestamp"))
    return valid.groupBy(*KEYS).agg(F.sum(cents("line_revenue")).alias("revenue_cents"), F.max("invoice_timestamp").alias("last_timestamp"))


def merged(states: DataFrame) -> DataFrame:
    """One row per key from the rows of several states."""
    return states.groupBy(*KEYS).agg(F.sum("revenue_cents").alias("revenue_cents"), F.max("last_timestamp").alias("last_timestamp"))


def _segments(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{root.rstrip('/')}/{n}" for n in names])


def merge_batch(spark: SparkSession, root: str, batch: str, lines: DataFrame) -> Version:
    """Merge the curated ``lines`` of a batch, known by its name, into the state below ``root``."""
    found = current(spark, root)
    notes = found.notes if found else {"batches": [], "segments": []}
    if batch in notes["batches"]:
        return found

    def build(folder: str) -> dict:
        state, others = sales_state(lines), notes["segments"]
        if len(others) >= MOST_SEGMENTS:
            state, others = merged(state.unionByName(_segments(spark, root, others))), []
        state.repartitionByRange(*KEYS[:3]).sortWithinPartitions(*KEYS[:3]).write.parquet(f"{folder}/state")
        own = folder.removeprefix(root.rstrip("/") + "/") + "/state"
        return {"batches": [*notes["batches"], batch], "segments": [*others, own]}

    return publish(spark, root, build)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all segments; keys can repeat, which every function below allows for."""
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no batch is merged below {root}")
    return _segments(spark, root, found.notes["segments"])


def expire_segments(spark: SparkSession, root: str) -> list[int]:
    """Remove earlier commits, and folders that the current commit does not name; the commits' numbers.

    For a time without readers of earlier commits.
    """
    found = current(spark, root)
    old = history(spark, root)[:-1]
    for number in old:
        folder = committed(spark, root, number).folder
        delete_path(spark, _commit_path(root.rstrip("/"), number))
        if not any(folder.endswith(n.removesuffix("/state")) for n in found.notes["segments"]):
            delete_path(spark, folder)
    return old


def state_slice(state: DataFrame, start: DateLike, end: DateLike | None = None, countries: Iterable[str] | None = None) -> DataFrame:
    """The part of the state that ``filtered_sales`` of the lines would leave."""
    first, last = date_range(start, end)
    kept = state.where(F.col("day").between(F.lit(first), F.lit(last)))
    chosen = list(countries or [])
    return kept.where(F.col("country").isin(chosen)) if chosen else kept


def state_invoices(state: DataFrame) -> DataFrame:
    """``sales.invoice_rollup`` from the state."""
    return state.groupBy("invoice_no", "customer_id").agg(F.sum("revenue_cents").alias("revenue_cents"), F.max("last_timestamp").alias("last_timestamp"))


def state_kpis(state: DataFrame) -> DataFrame:
    """``sales.kpi_summary`` from the state."""
    return sales.rollup_kpis(state_invoices(state))


def state_metrics(state: DataFrame, as_of: DateLike) -> DataFrame:
    """``rfm.customer_metrics`` from the state."""
    return rfm.rollup_metrics(state_invoices(state), as_of)


def _totals(state: DataFrame, key) -> DataFrame:
    revenue = (F.sum("revenue_cents").cast("double") / F.lit(100.0)).alias("revenue")
    return state.groupBy(key).agg(revenue, F.countDistinct("invoice_no").alias("orders"))


def state_trend(state: DataFrame) -> DataFrame:
    """``sales.monthly_trend`` from the state."""
    return _totals(state, F.trunc("day", "month").alias(sales.MONTH)).orderBy(sales.MONTH)


def state_markets(state: DataFrame, k: int = 15) -> DataFrame:
    """``sales.top_markets`` from the state."""
    order = F.col("revenue").desc_nulls_last(), F.col("country").asc_nulls_last()
    return _totals(state, F.col("country")).orderBy(*order).limit(k)
