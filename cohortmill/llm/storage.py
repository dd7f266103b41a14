"""Intermediate tables in the shared folder, and fixed-size filters that keep rows without partners out of shuffles."""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, new_path, observed, shared_dir, stage

__all__ = ["drop", "new_path", "observed", "shared_dir", "stage", "key_filter", "passes"]

MAX_BITS = 1 << 28


def key_filter(keys: DataFrame, column: str, bits: int) -> Broadcast:
    """A bit for each key of a long column, at key modulo ``bits`` (a power of two, at most 2^28: 32 MB whatever the
    input). Rows that pass may still have no partner, so an exact join must follow; destroy() it once that is written."""
    bits = min(MAX_BITS, max(1 << 15, bits))
    low = F.col(column).bitwiseAND(F.lit(bits - 1)).cast("long") + 1  # Spark's bitmap positions begin at 1
    at = keys.where(F.col(column).isNotNull()).select(low.alias("at"))
    at = at.select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    words = np.zeros(bits // 8, np.uint8)
    for bucket, part in at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("part")).collect():
        base = (bucket - 1) * 4096
        words[base : base + 4096] |= np.frombuffer(bytes(part), np.uint8)
    return keys.sparkSession.sparkContext.broadcast((words, bits))


def passes(filter_: Broadcast, keys: np.ndarray) -> np.ndarray:
    words, bits = filter_.value
    at = keys.astype(np.int64) & (bits - 1)
    return (words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
