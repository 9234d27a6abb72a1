"""Table functions for SQL text: the tiles of an extent, and walks over a slide's tiles in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegralType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from mosaiq.functions.grid import whole_div

#: Rows of tiles of a band.
BAND = 64


class TileCover:
    """``tile_cover(h, w, tile_h, tile_w)``: ty, tx, y0, y1, x0, x1 of every tile, row-major, clamped. For LATERAL joins."""

    @staticmethod
    def analyze(h: AnalyzeArgument, w: AnalyzeArgument, tile_h: AnalyzeArgument, tile_w: AnalyzeArgument) -> AnalyzeResult:
        for name, a in (("h", h), ("w", w), ("tile_h", tile_h), ("tile_w", tile_w)):
            if a.isTable or not isinstance(a.dataType, IntegralType):
                raise ValueError(f"tile_cover: {name} has to be a whole number")
            if name.startswith("tile") and a.isConstantExpression and a.value is not None and a.value < 1:
                raise ValueError(f"tile_cover: {name} has to be positive")
        schema = StructType()
        for name in ("ty", "tx", "y0", "y1", "x0", "x1"):
            schema = schema.add(name, LongType())
        return AnalyzeResult(schema)

    def eval(self, h: int, w: int, tile_h: int, tile_w: int) -> Iterator[tuple]:
        if None in (h, w, tile_h, tile_w):
            return
        for ty in range(-(-h // tile_h)):
            for tx in range(-(-w // tile_w)):
                yield ty, tx, ty * tile_h, min((ty + 1) * tile_h, h), tx * tile_w, min((tx + 1) * tile_w, w)


class TileWalk:
    """A walk over the tiles of each slide in row-major order; subclasses say what a tile gives.

    ``SELECT * FROM name(TABLE(tiles))``: the table needs slide_id, ty and tx. Spark deals it by slide and
    sorts it, one slide goes by one tile at a time, and ``visit`` keeps what it likes in between. A table with
    ``band`` and ``first_place`` (see ``banded``) is dealt by slide and band: each band is a walk of its own
    whose places go on from those of the bands before it.
    """

    #: Columns of the result, as DDL.
    returns = "slide_id string, ty bigint, tx bigint, place bigint, gap bigint"

    def __init__(self):
        self.place, self.before = 0, None

    def visit(self, tile: Row) -> Iterator[tuple]:
        """By default each tile's place, and how many columns lie between it and the one before in its row."""
        gap = tile["tx"] - self.before[1] - 1 if self.before and self.before[0] == tile["ty"] else tile["tx"]
        yield tile["slide_id"], tile["ty"], tile["tx"], self.place, gap

    def eval(self, tile: Row) -> Iterator[tuple]:
        if self.before is None and "first_place" in tile:
            self.place = tile["first_place"]
        yield from self.visit(tile)
        self.place, self.before = self.place + 1, (tile["ty"], tile["tx"])


def _handler(walk: type[TileWalk]) -> type[TileWalk]:
    """The walk with what Spark asks of it when a query names it; its columns are parsed on the driver."""
    returns = StructType.fromDDL(walk.returns)

    class Walk(walk):
        @staticmethod
        def analyze(tiles: AnalyzeArgument) -> AnalyzeResult:
            if not tiles.isTable or not {"slide_id", "ty", "tx"} <= set(tiles.dataType.names):
                raise ValueError("a table with slide_id, ty and tx is needed")
            by = ["slide_id", *(["band"] if {"band", "first_place"} <= set(tiles.dataType.names) else [])]
            return AnalyzeResult(returns, partitionBy=[PartitioningColumn(n) for n in by], orderBy=[OrderingColumn("ty"), OrderingColumn("tx")])

    return Walk


def banded(tiles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct tiles with their ``band`` of rows and its ``first_place``, for walks that need nothing of the rows before.

    One row a slide and band is broadcast. ``partitions``: among how many tasks the bands are dealt.
    """
    named = tiles.withColumn("band", whole_div(F.col("ty"), BAND))
    held = (named.repartition(partitions, "slide_id", "band") if partitions else named).distinct()
    before = Window.partitionBy("slide_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("slide_id", "band").agg(F.count("*").alias("n"))
    firsts = counts.select(F.col("slide_id").alias("_slide"), F.col("band").alias("_band"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_place"))
    return held.join(F.broadcast(firsts), F.col("slide_id").eqNullSafe(F.col("_slide")) & F.col("band").eqNullSafe(F.col("_band"))).drop("_slide", "_band")


def register(spark: SparkSession, walks: dict[str, type[TileWalk]] | None = None) -> None:
    """Makes ``tile_cover``, ``tile_walk`` and walks of the caller's own known to SQL."""
    spark.udtf.register("tile_cover", udtf(TileCover))
    for name, walk in {"tile_walk": TileWalk, **(walks or {})}.items():
        spark.udtf.register(name, udtf(_handler(walk)))
