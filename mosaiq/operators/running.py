"""Running sums and maxima over one global order, without a single-task window.

Whole-number keys are cut into chunks. A chunk is ordered on its own; what the chunks before it
add is one row a chunk, which alone goes through a global window and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def _chunked(df: DataFrame, key: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(key) / chunk))


def running_sum(df: DataFrame, key: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all smaller keys."""
    held = _chunked(df.withColumn("_value", value), key, chunk)
    totals = held.groupBy("_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return held.withColumn("_own", own).join(bases, "_chunk").withColumn(name, F.col("_base") + F.col("_own")).drop("_chunk", "_value", "_own", "_base")


def running_max(df: DataFrame, key: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the maximum of ``value`` over this and all smaller keys."""
    held = _chunked(df.withColumn("_value", value), key, chunk)
    tops = held.groupBy("_chunk").agg(F.max("_value").alias("_top"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = tops.select("_chunk", F.max("_top").over(before).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = F.max("_value").over(inside)
    return held.withColumn("_own", own).join(bases, "_chunk").withColumn(name, F.greatest("_base", "_own")).drop("_chunk", "_value", "_own", "_base")
