"""Documents in blocks of neighbouring rows, for exchanges by block instead of by token.

Counting tokens and bringing the counts back to each token would shuffle every
token twice.  Instead a block, a run of rows of one input file, asks once for
each of its distinct keys and gets one answer for it.  A block is named by file
and row number, so every pass over the input finds the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_ROWS = 1024


def with_blocks(docs: DataFrame, columns: list[Column], kind: Column | int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """``columns`` and ``block``; the lowest two bits of a block are its ``kind``, 0 to 3.

    A frame that is not a plain file scan is written to the shared folder first.
    """
    kind = F.lit(kind) if isinstance(kind, int) else kind
    name = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))
    block = name.bitwiseAND(F.lit(-4)).bitwiseOR(kind.cast("long")).alias("block")
    try:
        return docs.select(*columns, block)
    except AnalysisException:
        return materialize(docs, "blocks").select(*columns, block)


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows of each block."""
    blocks = batch.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    cut = np.flatnonzero(np.diff(blocks[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(blocks[part[0]]), batch.take(pa.array(part))


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block: all its columns, compressed."""
    for batch in batches:
        for block, part in by_block(batch):
            raw = _pack(part.select([c for c in part.schema.names if c != "block"]))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([raw], pa.binary())], names=["block", "texts"])


def _pack(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def unpack_texts(cells: list[bytes]) -> pa.Table:
    """The rows of packed blocks."""
    return pa.concat_tables([pa.ipc.open_stream(c).read_all() for c in cells]).combine_chunks()
