"""Tiles as packed bytes and as cells, the fast tile kernels, blank tiles, and region reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.grid import bounded, whole_div
from mosaiq.operators.coverage import blanks, within

TILE = "slide_id string, ty bigint, tx bigint, y0 bigint, x0 bigint, h bigint, w bigint, c bigint, payload binary"


def _tiles(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    types = [pa.string(), *[pa.int64()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], [x.split()[0] for x in TILE.split(", ")])


def tiles_to_cells(tiles: DataFrame) -> DataFrame:
    """(slide_id, y, x, c, v) of every pixel of packed tiles."""

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for t in batch.to_pylist():
                v = np.frombuffer(t["payload"], np.uint8)
                y, x, c = (a.ravel() for a in np.indices((t["h"], t["w"], t["c"])))
                yield pa.RecordBatch.from_arrays([pa.array([t["slide_id"]] * len(v), pa.string()), pa.array(y + t["y0"]), pa.array(x + t["x0"]), pa.array(c), pa.array(v.astype(np.int64))], ["slide_id", "y", "x", "c", "v"])

    return tiles.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in TILE.split(", ")]).mapInArrow(unpack, "slide_id string, y bigint, x bigint, c bigint, v bigint")


def cells_to_tiles(cells: DataFrame, tile_h: int, tile_w: int, h: int, w: int, c: int) -> DataFrame:
    """Packed tiles of the cells; a group is one tile's cells, and cells that are missing are 0."""

    def assemble(table):
        import numpy as np
        import pyarrow as pa

        ty, tx = table["ty"][0].as_py(), table["tx"][0].as_py()
        y0, x0 = ty * tile_h, tx * tile_w
        out = np.zeros((min(tile_h, h - y0), min(tile_w, w - x0), c), np.uint8)
        at = [table[n].to_numpy() for n in ("y", "x", "c", "v")]
        out[at[0] - y0, at[1] - x0, at[2]] = at[3]
        return pa.Table.from_batches([_tiles([(table["slide_id"][0].as_py(), ty, tx, y0, x0, out.shape[0], out.shape[1], c, out.tobytes())])])

    named = cells.select("slide_id", whole_div(F.col("y"), tile_h).alias("ty"), whole_div(F.col("x"), tile_w).alias("tx"), *[F.col(n).cast("bigint").alias(n) for n in ("y", "x", "c", "v")])
    return named.groupBy("slide_id", "ty", "tx").applyInArrow(assemble, TILE)


def pool_tiles(tiles: DataFrame, factor: int, tile_h: int, tile_w: int) -> DataFrame:
    """Truncated block means within each tile, in Arrow batches; needs no shuffle."""

    def pool(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                h, w, c = t["h"] // factor, t["w"] // factor, t["c"]
                if not h or not w:
                    continue
                pixels = np.frombuffer(t["payload"], np.uint8).reshape(t["h"], t["w"], c)[: h * factor, : w * factor]
                # sums of whole numbers are exact, as an average of cells is
                means = pixels.reshape(h, factor, w, factor, c).sum(axis=(1, 3), dtype=np.int64) // (factor * factor)
                rows.append((t["slide_id"], t["ty"], t["tx"], t["ty"] * (tile_h // factor), t["tx"] * (tile_w // factor), h, w, c, means.astype(np.uint8).tobytes()))
            yield _tiles(rows)

    return tiles.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in TILE.split(", ")]).mapInArrow(pool, TILE)


def blank_tiles(tiles: DataFrame, h: int, w: int, tile_h: int, tile_w: int, partitions: int | None = None) -> DataFrame:
    """Tiles of the grid that ``tiles`` lacks; what is shuffled grows with ``tiles``, not with the grid."""
    return bounded(blanks(tiles, h, w, tile_h, tile_w, partitions), h, w, tile_h, tile_w)


def fill_blanks(tiles: DataFrame, value: str, h: int, w: int, tile_h: int, tile_w: int, partitions: int | None = None) -> DataFrame:
    """Every tile of the grid; 0 where there is none.

    Both parts begin with the same filter, so that Spark shuffles what ``tiles`` come from once for both.
    """
    held = within(tiles, h, w, tile_h, tile_w).select(F.col("ty").cast("bigint"), F.col("tx").cast("bigint"), F.coalesce(value, F.lit(0)).alias(value))
    missing = blanks(tiles, h, w, tile_h, tile_w, partitions)
    return held.unionByName(missing.select("ty", "tx", F.lit(0).cast(held.schema[value].dataType).alias(value)))


def region(cells: DataFrame, rows: slice, columns: slice, h: int, w: int) -> DataFrame:
    """Cells of a region; an open end is the extent, and a stop beyond it is clamped."""
    a, b = rows.start or 0, min(h if rows.stop is None else rows.stop, h)
    p, q = columns.start or 0, min(w if columns.stop is None else columns.stop, w)
    return cells.filter(F.col("y").between(a, b - 1) & F.col("x").between(p, q - 1))
