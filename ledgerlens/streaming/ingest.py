"""Continuous ingest: landing files arriving in a folder → curated Parquet.

The batch job's validation is a stateless projection, so the same
``normalise`` runs on a Structured Streaming file source.  Each micro-batch
(``foreachBatch``) numbers rows per file (a file is never split across
micro-batches), validates them, and writes

* curated lines to ``{output}/batch_id=<epoch>``,
* quarantined rows to ``{quarantine}/batch_id=<epoch>``,
* the batch's staged-row count to ``{output}_counts/batch_id=<epoch>``,

each with dynamic partition overwrite, so a micro-batch replayed after a
failure replaces its own output instead of appending twice.  Line ids stay
dense across batches: a batch starts after the staged rows of all earlier
batches, read from the small counts table (one row per batch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.curation import CURATED_SCHEMA, with_sale_flags
from ..operators.ingest import ORDINAL, RAW_HEADERS, normalise, split_checked
from ..operators.ranking import row_number_by_position
from ..session import path_exists
from ..sources.landing import csv_cells, number_tagged, tag_sequence, tag_splits

LANDING_SCHEMA = T.StructType([T.StructField(h, T.StringType(), True) for h in RAW_HEADERS])


def _staged_before(spark: SparkSession, counts_path: str, epoch: int) -> int:
    if not path_exists(spark, counts_path):  # no batch committed yet
        return 0
    counts = spark.read.parquet(counts_path)
    total = counts.where(F.col("batch_id") < epoch).agg(F.sum("staged_rows")).first()[0]
    return int(total or 0)


def process_batch(
    batch: DataFrame,
    epoch: int,
    period: str | None,
    output: str,
    quarantine: str,
) -> None:
    """Validate one micro-batch and write its three outputs idempotently."""
    spark = batch.sparkSession
    overwrite = {"partitionOverwriteMode": "dynamic"}
    # sequence ids on the micro-batch scan, kept for the two reads below
    batch = tag_sequence(batch).persist()
    checked = None
    try:
        if "value" in batch.columns:  # CSV lines: every file is checked and bound by its own header
            numbered = csv_cells(batch, period or "landing", {}, per_file=True)
        else:
            numbered = number_tagged(batch, per_file=True)
        period_col = (
            F.lit(period) if period is not None else F.element_at(F.split("_ln_file", "/"), -2)
        )
        # order key of the rows inside this batch: file path, then row
        raw = numbered.select(
            F.col("_ln_file").alias(ORDINAL),
            period_col.alias("source_period"),
            "source_row",
            *[F.col(f"`{h}`") for h in RAW_HEADERS],
        )
        checked = normalise(raw).checked.persist()
        staged, quarantined = split_checked(checked)
        offset = _staged_before(spark, f"{output}_counts", epoch)
        ids = row_number_by_position(
            staged, ORDINAL, "source_row", name="transaction_line_id", start=offset + 1
        )
        curated = with_sale_flags(ids).select(
            *[f.name for f in CURATED_SCHEMA.fields], F.lit(epoch).alias("batch_id")
        )
        curated.sortWithinPartitions("invoice_timestamp").write.mode("overwrite").options(
            **overwrite
        ).partitionBy("batch_id").option("compression", "zstd").parquet(output)
        bad = quarantined.withColumn("batch_id", F.lit(epoch))
        bad.write.mode("overwrite").options(**overwrite).partitionBy("batch_id").option(
            "header", "true"
        ).csv(quarantine)
        counts = staged.agg(F.count(F.lit(1)).alias("staged_rows")).select(
            F.lit(epoch).cast("long").alias("batch_id"), "staged_rows"
        )
        counts.write.mode("overwrite").options(**overwrite).partitionBy("batch_id").parquet(
            f"{output}_counts"
        )
    finally:
        if checked is not None:
            checked.unpersist()
        batch.unpersist()


def start_ingest_stream(
    spark: SparkSession,
    landing_dir: str,
    output: str,
    quarantine: str,
    checkpoint: str,
    period: str | None = None,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
    fmt: str = "csv",
) -> StreamingQuery:
    """Start the stream; ``period=None`` takes each file's folder name.

    ``fmt`` is ``csv`` (with header) or ``json`` (JSON lines; with the
    all-text schema, numbers arrive as their text).
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "csv":
        source = reader.text(landing_dir)
    elif fmt == "json":
        source = reader.schema(LANDING_SCHEMA).json(landing_dir)
    else:
        raise ValueError(f"unsupported landing format: {fmt!r}")
    stream = tag_splits(source)
    writer = stream.writeStream.foreachBatch(
        lambda df, epoch: process_batch(df, epoch, period, output, quarantine)
    ).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
