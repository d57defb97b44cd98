"""A fixed-size bitmap of wanted keys, to select rows during a text scan.

A scan of whole texts should not be shuffled just to keep a few documents.
The wanted keys are hashed into a bitmap whose size is a parameter, whatever
the number of keys; a false positive only yields a row that the join after
the scan drops.  The driver sees at most ``BITS / 64`` words of the bitmap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed
from .textops import U64

BITS = 1 << 22


def key_bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of ``keys[column]``, a 64-bit hash: its low bits choose the bit."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    with shuffles_removed(keys.sparkSession):
        words = (
            keys.where(F.col(column).isNotNull())
            .select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("m"))
            .groupBy("w")
            .agg(F.bit_or("m").alias("m"))
            .collect()
        )
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words:
        out[row.w] = row.m
    return out.view(U64)


def wanted(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may be in ``bitmap``."""
    slot = keys.astype(U64) & U64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1

