"""Block reductions over ``cells(y, x[, c], v)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.grid import whole_div


def to_byte(mean: Column) -> Column:
    """A mean as an unsigned byte: clipped, then truncated."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), mean))).cast("bigint")


def trim(cells: DataFrame, h: int, w: int, block_h: int, block_w: int) -> DataFrame:
    """Without the rows and columns that do not fill a block."""
    return cells.filter((F.col("y") < h // block_h * block_h) & (F.col("x") < w // block_w * block_w))


def block_reduce(cells: DataFrame, block_h: int, block_w: int, aggregates: list[Column]) -> DataFrame:
    """Any aggregates of each block; the reducer is the caller's (pooled min, max, a UDAF, ...).

    Cells that already have their block as ``by`` and ``bx`` are not shuffled where they are dealt by it.
    """
    named = cells if {"by", "bx"} <= set(cells.columns) else cells.withColumns({"by": whole_div(F.col("y"), block_h), "bx": whole_div(F.col("x"), block_w)})
    return named.groupBy("by", "bx", *(["c"] if "c" in cells.columns else [])).agg(*aggregates).withColumnsRenamed({"by": "y", "bx": "x"})


def mean_pool(cells: DataFrame, factor: int, h: int | None = None, w: int | None = None) -> DataFrame:
    """Truncated block means; with the extents, incomplete blocks are left out."""
    kept = cells if h is None or w is None else trim(cells, h, w, factor, factor)
    return block_reduce(kept, factor, factor, [to_byte(F.avg("v")).alias("v")])


def mean_pool_tiled(cells: DataFrame, factor: int, tile_h: int, tile_w: int, h: int, w: int) -> DataFrame:
    """Block means within each tile, the remainder trimmed tile by tile and the rest packed."""

    def axis(name: str, tile: int, extent: int):
        at, index = F.col(name) % tile, whole_div(F.col(name), tile)
        size = F.least(F.lit(tile).cast("bigint"), F.lit(extent).cast("bigint") - index * tile)
        return at < size - size % factor, index * (tile // factor) + whole_div(at, factor)

    keep_y, y = axis("y", tile_h, h)
    keep_x, x = axis("x", tile_w, w)
    kept = cells.filter(keep_y & keep_x)
    return kept.groupBy(y.cast("bigint").alias("y"), x.cast("bigint").alias("x"), *(["c"] if "c" in cells.columns else [])).agg(to_byte(F.avg("v")).alias("v"))
