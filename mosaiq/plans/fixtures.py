"""Rasters, frames and streams derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.grid import whole_div

TILE_H, TILE_W, WIDTH = 48, 24, 64
#: Rows that one task of a raster of rows takes.
TASK_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an image: y, x, v."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 127.5)))
    return cells.select("y", F.col("x").cast("bigint").alias("x"), v.cast("bigint").alias("v"))


def height_e(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def partitions_l(spark: SparkSession, sf_dir: str) -> int:
    """Among how many tasks the rows of raster L are dealt, so that no task's tables and sorts grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def raster_l(spark: SparkSession, sf_dir: str, block_h: int = 1, block_w: int = 1) -> DataFrame:
    """Suppliers by parts, sparse, three channels in rows: by, bx, y, x, c, v.

    Dealt by block (by, bx), so that what groups by it needs no other shuffle.
    """
    y, x = F.col("l_suppkey"), F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(whole_div(y, block_h).alias("by"), whole_div(x, block_w).alias("bx"), y.alias("y"), x.alias("x"), "l_quantity", "l_linenumber")
    dealt = rows.repartition(partitions_l(spark, sf_dir), "by", "bx")
    grouped = dealt.groupBy("by", "bx", "y", "x").agg(F.sum("l_quantity").cast("bigint").alias("a"), F.sum("l_linenumber").cast("bigint").alias("b"), F.count("*").alias("n"))
    stacked = F.posexplode(F.array(F.col("a") % 256, F.col("b") % 256, F.col("n") % 256)).alias("c", "v")
    return grouped.select("by", "bx", "y", "x", stacked).withColumn("c", F.col("c").cast("bigint"))


def places_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x of the cells that raster L has, some more than once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x"))


def extent_l(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.encode("text", "UTF-8").alias("payload"), F.octet_length("text").cast("bigint").alias("len"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = events.count()
    return events.select(((F.col("event_id") * 7919) % n).alias("k"), F.col("ts").alias("arrival"))


# The units that the resolutions of parts take in turn.
UNITS = ("um", "mm", "cm", "inch", "2", "3")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 20.0).alias("mpp"), unit.alias("unit"))
