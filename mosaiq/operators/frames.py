"""Encapsulated frames: even lengths, and the offsets of an extended offset table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.running import running_sum

#: Bytes of an item's tag and length before its frame.
ITEM_HEADER = 8


def even(length: Column) -> Column:
    return length + length % 2


def frame_offsets(frames: DataFrame, index: str = "i", length: str = "len") -> DataFrame:
    """Adds padded_len and byte offset of each frame, from the first frame's item on."""
    padded = frames.withColumn("padded_len", even(F.col(length)))
    return running_sum(padded, index, F.col("padded_len") + ITEM_HEADER, "byte_offset")
