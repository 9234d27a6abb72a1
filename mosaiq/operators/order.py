"""In-order release of tiles that arrive out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.running import running_max


def release_times(arrivals: DataFrame, key: str = "k", arrival: str = "arrival") -> DataFrame:
    """Adds released: when a tile and all before it have arrived."""
    return running_max(arrivals, key, F.col(arrival), "released")


def row_major(tiles: DataFrame, mosaic_w: int) -> DataFrame:
    """Adds the row-major index, which needs no ordering in a whole grid."""
    return tiles.withColumn("idx", F.col("ty") * mosaic_w + F.col("tx"))
