"""Which tiles of a grid are there: bitmaps of buckets, and the runs that are missing.

Row-major indices go to buckets of 32768 bits. A bucket's bitmap and its inner gaps need only its own
rows, in any order and with repeats; the gaps between buckets need one row a bucket, ordered within a slide's level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.grid import tile_start, tile_stop, tiles_across, whole_div

LEVEL = ("slide_id", "level")
#: A gap between buckets is laid out in pieces of so many tiles, and one task has pieces of about so many.
PIECE, TASK_TILES = 1 << 16, 1 << 24
#: Blanks are laid out along lines of so many tiles, and dealt in buckets of so many: a file of them has few distinct
#: ty and tx, in runs and cycles, and takes a small part of the bytes that rows of the whole grid take.
BAND, BUCKET = 1 << 8, 1 << 18


def _held(tiles: DataFrame, across: Column | int, down: Column | int, keys: Sequence[str], partitions: int | None) -> DataFrame:
    """keys, bucket and row-major index of the tiles within the grid, dealt by bucket; repeats stay."""
    inside = tiles.filter((F.col("ty") >= 0) & (F.col("ty") < down) & (F.col("tx") >= 0) & (F.col("tx") < across))
    held = inside.select(*keys, (F.col("ty").cast("bigint") * across + F.col("tx")).alias("idx"))
    held = held.withColumn("bucket", F.bitmap_bucket_number(F.col("idx") + 1))  # bitmaps count from 1
    return held.repartition(partitions, *keys, "bucket") if partitions else held


def _bitmaps(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    bits = held.select(*keys, "bucket", F.bitmap_bit_position(F.col("idx") + 1).alias("bit"))
    return bits.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).withColumn("n_present", F.bitmap_count("bitmap"))


def _gaps(held: DataFrame, n: Column | int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """keys, first, last of the indices that are missing: within buckets, and between and after them.

    Without keys all is one level, which may hold nothing.
    """
    of_bucket = Window.partitionBy(*keys, "bucket").orderBy("idx")
    gaps = held.select(*keys, (F.lag("idx").over(of_bucket) + 1).alias("first"), (F.col("idx") - 1).alias("last"))
    ends = held.groupBy(*keys, "bucket").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    of_level = Window.partitionBy(*keys).orderBy("bucket")
    between = ends.select(*keys, (F.coalesce(F.lag("high").over(of_level), F.lit(-1)) + 1).alias("first"), (F.col("low") - 1).alias("last"))
    tail = ends.groupBy(*keys).agg((F.coalesce(F.max("high"), F.lit(-1)) + 1).alias("first")).select(*keys, "first", (F.lit(n) - 1).cast("bigint").alias("last"))
    some = F.col("first") <= F.col("last")
    return gaps.filter(some), between.unionByName(tail).filter(some)


def coverage(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int, partitions: int | None = None) -> DataFrame:
    """slide_id, level, bucket, n_present, bitmap of the tiles (slide_id, level, ty, tx); repeats count once.

    ``partitions``, here and below: among how many tasks buckets are dealt, for tiles too many for as many as Spark picks.
    """
    held = _held(tiles, tiles_across(w, tile_w), tiles_across(h, tile_h), LEVEL, partitions)
    return _bitmaps(held, LEVEL).select(*LEVEL, "bucket", "n_present", "bitmap")


def missing_runs(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int, partitions: int | None = None) -> DataFrame:
    """slide_id, level, first, last: the maximal runs of row-major indices of which there is no tile.

    A level of which there is no tile at all is no level here.
    """
    across, down = tiles_across(w, tile_w), tiles_across(h, tile_h)
    inner, outer = _gaps(_held(tiles, across, down, LEVEL, partitions), across * down, LEVEL)
    return inner.unionByName(outer)


def within(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int) -> DataFrame:
    """The tiles that lie in the grid."""
    return tiles.filter(F.col("ty").between(0, -(-h // tile_h) - 1) & F.col("tx").between(0, -(-w // tile_w) - 1))


def blanks(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int, partitions: int | None = None) -> DataFrame:
    """ty, tx of the grid's tiles that ``tiles`` (ty, tx) lacks; the grid itself is neither made nor shuffled.

    The grid is cut into bands of columns, whose rows are lines, one band's after another's. Gaps along the lines are laid
    out where they are found; those between buckets, which may be long, are dealt in pieces, neighbours together.
    """
    down, across = -(-h // tile_h), -(-w // tile_w)
    wide = max(1, min(BAND, across))  # the last band may be narrower; what its lines lack is cut off below
    lines = -(-across // wide) * down
    inside = within(tiles, h, w, tile_h, tile_w).select(F.col("ty").cast("bigint"), F.col("tx").cast("bigint"))
    idx = (whole_div(F.col("tx"), wide) * down + F.col("ty")) * wide + F.col("tx") % wide
    held = inside.select(idx.alias("idx")).withColumn("bucket", whole_div(F.col("idx"), BUCKET))
    inner, outer = _gaps(held.repartition(partitions, "bucket") if partitions else held, lines * wide, ())
    starts = outer.select(F.explode(F.sequence("first", "last", F.lit(PIECE))).alias("first"), "last")
    pieces = starts.select("first", F.least("last", F.col("first") + (PIECE - 1)).alias("last"))
    n = max(tiles.sparkSession.sparkContext.defaultParallelism, -(-lines * wide // TASK_TILES))
    gaps = inner.unionByName(pieces.repartitionByRange(n, "first"))
    ends = gaps.select("first", "last", whole_div(F.col("first"), wide).alias("top"), whole_div(F.col("last"), wide).alias("end"))
    parts = ends.select("*", F.explode(F.sequence("top", "end")).alias("line")).select("*", whole_div(F.col("line"), max(1, down)).alias("band"))
    left, line = F.col("band") * wide, F.col("line")
    low = left + F.when(line == F.col("top"), F.col("first") - line * wide).otherwise(0)
    high = F.least(left + F.when(line == F.col("end"), F.col("last") - line * wide).otherwise(wide - 1), F.lit(across - 1))
    spans = parts.select((line - F.col("band") * down).alias("ty"), low.alias("low"), high.alias("high")).filter(F.col("low") <= F.col("high"))
    return spans.select("ty", F.explode(F.sequence("low", "high")).alias("tx"))


def layout_summary(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int, partitions: int | None = None) -> DataFrame:
    """slide_id, level, n_tiles, n_present, n_runs, whole: what is there of each level, and whether all is."""
    present = coverage(tiles, h, w, tile_h, tile_w, partitions).groupBy(*LEVEL).agg(F.sum("n_present").alias("n_present"))
    runs = missing_runs(tiles, h, w, tile_h, tile_w, partitions).groupBy(*LEVEL).agg(F.count("*").alias("n_runs"))
    n = tiles_across(h, tile_h) * tiles_across(w, tile_w)
    joined = present.join(runs, list(LEVEL), "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0).cast("bigint")))
    return joined.select(*LEVEL, n.alias("n_tiles"), "n_present", "n_runs", (F.col("n_present") == n).alias("whole"))


def full_copy(tiles: DataFrame, h: int, w: int, c: int, tile_h: int, tile_w: int) -> DataFrame:
    """Packed tiles (``mosaiq.sources.chunks.TILES``) and one of zeros for each that is missing."""
    across = tiles_across(w, tile_w)
    idx = missing_runs(tiles, h, w, tile_h, tile_w).select(*LEVEL, F.explode(F.sequence("first", "last")).alias("idx"))
    ty, tx = F.col("ty"), F.col("tx")
    places = idx.select(*LEVEL, whole_div(F.col("idx"), across).alias("ty"), (F.col("idx") % across).alias("tx"))
    sized = places.select("*", tile_start(ty, tile_h).alias("y0"), tile_start(tx, tile_w).alias("x0"), (tile_stop(ty, tile_h, h) - tile_start(ty, tile_h)).alias("h"), (tile_stop(tx, tile_w, w) - tile_start(tx, tile_w)).alias("w"), F.lit(c).cast("bigint").alias("c"))
    return tiles.unionByName(sized.withColumn("payload", F.unhex(F.repeat(F.lit("00"), (F.col("h") * F.col("w") * c).cast("int")))))
