"""Resolution pyramids in two modes that differ in their results: truncation compounds in a cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.reduce import mean_pool


def _check(factors: list[int]) -> None:
    before = 1
    for factor in factors:
        if factor <= before or factor % before:
            raise ValueError(f"downsamples must be growing multiples of each other: {factors}")
        before = factor


def _level(cells: DataFrame, factor: int) -> DataFrame:
    rest = [c for c in ("c",) if c in cells.columns]
    return cells.select(F.lit(factor).cast("bigint").alias("downsample"), "y", "x", *rest, "v")


def cascade(cells: DataFrame, factors: list[int], h: int, w: int) -> DataFrame:
    """Each level from the one before; levels are stacked with their downsample."""
    _check(factors)
    levels, below, before = [], cells, 1
    for factor in factors:
        below = mean_pool(below, factor // before, h // before, w // before)
        levels.append(_level(below, factor))
        before = factor
    return reduce(DataFrame.unionByName, levels)


def direct(cells: DataFrame, factors: list[int], h: int, w: int) -> DataFrame:
    """Each level straight from the base."""
    if any(f < 1 for f in factors):
        raise ValueError(f"downsamples must be positive: {factors}")
    return reduce(DataFrame.unionByName, [_level(mean_pool(cells, f, h, w), f) for f in factors])


def drift(cells: DataFrame, factors: list[int], h: int, w: int) -> DataFrame:
    """How many cells of each level the two modes give different values."""
    a, b = cascade(cells, factors, h, w), direct(cells, factors, h, w).withColumnRenamed("v", "direct")
    joined = a.join(b, ["downsample", "y", "x"])
    return joined.groupBy("downsample").agg(F.count("*").alias("n_cells"), F.count_if(F.col("v") != F.col("direct")).alias("n_differ"))


def level_factors(levels: DataFrame) -> DataFrame:
    """Adds the factor between each level and the one before it (one slide's levels are few)."""
    window = Window.partitionBy(*(["slide_id"] if "slide_id" in levels.columns else [F.lit(0)])).orderBy("level")
    d = F.col("downsample")
    return levels.withColumn("factor", ((d - d % F.lag(d, 1, 1).over(window)) / F.lag(d, 1, 1).over(window)).cast("bigint"))
