"""Tile-grid arithmetic as column expressions, with plain-Python twins for the driver.

All shapes and indices are (y, x); the twins take tuples of any rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnOrInt = Column | int


def _col(value: ColumnOrInt) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def whole_div(a: ColumnOrInt, b: ColumnOrInt) -> Column:
    """Quotient of non-negative whole numbers, as bigint."""
    return ((_col(a) - _col(a) % _col(b)) / _col(b)).cast("bigint")


def tiles_across(extent: ColumnOrInt, tile: ColumnOrInt) -> Column:
    return F.ceil(_col(extent) / _col(tile)).cast("bigint")


def tile_start(index: ColumnOrInt, tile: ColumnOrInt) -> Column:
    return (_col(index) * _col(tile)).cast("bigint")


def tile_stop(index: ColumnOrInt, tile: ColumnOrInt, extent: ColumnOrInt | None = None) -> Column:
    """End of a tile, clamped if an extent is given."""
    stop = (_col(index) + 1) * _col(tile)
    return (stop if extent is None else F.least(stop, _col(extent))).cast("bigint")


def downsampled(extent: ColumnOrInt, factor: ColumnOrInt, rounding: Callable[[Column], Column] = F.floor) -> Column:
    return rounding(_col(extent) / _col(factor)).cast("bigint")


def block_downsampled(extent: ColumnOrInt, factor: ColumnOrInt, block: ColumnOrInt) -> Column:
    """Extent after each block was downsampled and trimmed on its own."""
    whole, rest = whole_div(extent, block), _col(extent) % _col(block)
    return (whole * whole_div(block, factor) + whole_div(rest, factor)).cast("bigint")


def fit_scale(h: Column, w: Column, most_h: Column, most_w: Column) -> Column:
    return F.least(most_h.cast("double") / h.cast("double"), most_w.cast("double") / w.cast("double"))


def wrap(y: Column, x: Column, h: ColumnOrInt, w: ColumnOrInt) -> tuple[Column, Column, Column]:
    """Carry an index past the row's end into y, and past the last row into an overflow."""
    carried = _col(y) + whole_div(x, w)
    return carried % _col(h), _col(x) % _col(w), whole_div(carried, h)


def _spread(x: Column) -> Column:
    """The 31 low bits of a bigint, each with a zero bit after it."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(y: ColumnOrInt, x: ColumnOrInt) -> Column:
    """The place of a tile along the Z-order curve; indices below 2^31."""
    return F.shiftleft(_spread(_col(y)), 1).bitwiseOR(_spread(_col(x)))


def increasing(values: Column) -> Column:
    """Whether an array increases strictly; true up to one element."""
    return F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.size(values)), lambda a, b: a < b), lambda ok: ok)


def grid(spark: SparkSession, h: int, w: int, tile_h: int, tile_w: int) -> DataFrame:
    """Every tile of an array in row-major order: ty, tx, y0, y1, x0, x1 (clamped)."""
    rows, cols = -(-h // tile_h), -(-w // tile_w)
    ids = spark.range(rows * cols).select(whole_div(F.col("id"), cols).alias("ty"), (F.col("id") % cols).alias("tx"))
    return bounded(ids, h, w, tile_h, tile_w)


def bounded(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int) -> DataFrame:
    """ty, tx of tiles with their bounds: y0, y1, x0, x1 (clamped)."""
    return tiles.select("ty", "tx", tile_start(F.col("ty"), tile_h).alias("y0"), tile_stop(F.col("ty"), tile_h, h).alias("y1"), tile_start(F.col("tx"), tile_w).alias("x0"), tile_stop(F.col("tx"), tile_w, w).alias("x1"))


# twins


def mosaic_shape(array: Sequence[int], tile: Sequence[int]) -> tuple[int, ...]:
    return tuple(-(-a // t) for a, t in zip(array, tile, strict=False))


def tile_slices(index: Sequence[int], shape: Sequence[int]) -> tuple[slice, ...]:
    return tuple(slice(i * s, (i + 1) * s) for i, s in zip(index, shape, strict=False))


def downsample_shape(shape: Sequence[int], factor: float | Sequence[float], rounding: Callable = math.floor) -> tuple[int, ...]:
    factors = [factor] * len(shape) if isinstance(factor, int | float) else list(factor)
    if len(factors) != len(shape):
        raise ValueError("one factor for each axis is needed")
    return tuple(int(rounding(s / f)) for s, f in zip(shape, factors, strict=True))


def block_downsample_shape(shape: Sequence[int], factor: int, block: Sequence[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    inner = tuple(b // factor for b in block)
    return tuple(s // b * i + s % b // factor for s, b, i in zip(shape, block, inner, strict=True)), inner


def scale_to_fit(shape: Sequence[int], most: Sequence[int]) -> float:
    return min(m / s for s, m in zip(shape, most, strict=True))


def wrap_index(index: Sequence[int], shape: Sequence[int], last_is_least: bool = True) -> tuple[tuple[int, ...], int]:
    """Mixed-radix carry; the last axis is the least significant, or else the first."""
    if len(index) != len(shape):
        raise ValueError("index and shape have different ranks")
    order = range(len(shape) - 1, -1, -1) if last_is_least else range(len(shape))
    out, carry = [0] * len(shape), 0
    for axis in order:
        carry, out[axis] = divmod(index[axis] + carry, shape[axis])
    return tuple(out), carry


def strictly_increasing(values: Sequence) -> bool:
    return all(a < b for a, b in zip(values, values[1:], strict=False))


def thumbnail_downsample(shape: Sequence[int], tile: Sequence[int], target: Sequence[int]) -> int:
    """The smallest factor of at least 1 whose per-tile downsampling fits the target."""
    factor = 1
    while any(s > t for s, t in zip(block_downsample_shape(shape, factor, tile)[0], target, strict=True)):
        factor += 1
    return factor
