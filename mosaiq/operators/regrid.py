"""From one tile size to another: overlaps by bucket and equi-join, and when a tile is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.grid import whole_div


def overlaps(read: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """``read`` (with y0, y1, x0, x1) once for each tile (oy, ox) of the other grid it meets.

    A read tile names the tiles it covers, so matching is a hash join on (oy, ox) afterwards and
    never a comparison of all pairs.
    """
    span = lambda a, b, size: F.sequence(whole_div(F.col(a), size), whole_div(F.col(b) - 1, size))
    return read.withColumn("oy", F.explode(span("y0", "y1", tile_h))).withColumn("ox", F.explode(span("x0", "x1", tile_w)))


def overlap_areas(read: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Adds the area that each read tile shares with the other grid's tile."""
    side = lambda a, b, i, size: F.least(F.col(b), (F.col(i) + 1) * size) - F.greatest(F.col(a), F.col(i) * size)
    return overlaps(read, tile_h, tile_w).withColumn("area", (side("y0", "y1", "oy", tile_h) * side("x0", "x1", "ox", tile_w)).cast("bigint"))


def ready_times(read: DataFrame, tile_h: int, tile_w: int, arrival: str = "arrival") -> DataFrame:
    """When all tiles that an output tile needs have arrived: oy, ox, n_needed, ready.

    Null until each of them has an arrival.
    """
    met = overlaps(read, tile_h, tile_w).groupBy("oy", "ox")
    made = met.agg(F.count("*").alias("n_needed"), F.count(arrival).alias("_come"), F.max(arrival).alias("_last"))
    return made.select("oy", "ox", "n_needed", F.when(F.col("_come") == F.col("n_needed"), F.col("_last")).alias("ready"))


def regrid_tiles(tiles: DataFrame, tile_h: int, tile_w: int, h: int, w: int) -> DataFrame:
    """Tiles (ty, tx, y0, x0, h, w, c, payload of unsigned bytes) cut anew.

    Fragments are cut in Arrow batches, shuffled once on (slide_id, oy, ox), and assembled; a group
    is the fragments of one output tile. Cells that no tile covers are 0.
    """
    kind = "slide_id string, oy bigint, ox bigint, y0 bigint, x0 bigint, h bigint, w bigint, c bigint, payload binary"

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                pixels = np.frombuffer(t["payload"], np.uint8).reshape(t["h"], t["w"], t["c"])
                for oy in range(t["y0"] // tile_h, (t["y0"] + t["h"] - 1) // tile_h + 1):
                    for ox in range(t["x0"] // tile_w, (t["x0"] + t["w"] - 1) // tile_w + 1):
                        a, b = max(t["y0"], oy * tile_h), min(t["y0"] + t["h"], (oy + 1) * tile_h)
                        p, q = max(t["x0"], ox * tile_w), min(t["x0"] + t["w"], (ox + 1) * tile_w)
                        part = pixels[a - t["y0"] : b - t["y0"], p - t["x0"] : q - t["x0"]]
                        rows.append((t["slide_id"], oy, ox, a, p, b - a, q - p, t["c"], part.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.string(), *[pa.int64()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], [x.split()[0] for x in kind.split(", ")])

    def assemble(table):
        import numpy as np
        import pyarrow as pa

        rows = table.to_pylist()
        oy, ox, c = rows[0]["oy"], rows[0]["ox"], rows[0]["c"]
        y0, x0 = oy * tile_h, ox * tile_w
        out = np.zeros((min(tile_h, h - y0), min(tile_w, w - x0), c), np.uint8)
        for r in rows:
            out[r["y0"] - y0 : r["y0"] - y0 + r["h"], r["x0"] - x0 : r["x0"] - x0 + r["w"]] = np.frombuffer(r["payload"], np.uint8).reshape(r["h"], r["w"], c)
        made = {"slide_id": [rows[0]["slide_id"]], "ty": [oy], "tx": [ox], "y0": [y0], "x0": [x0], "h": [out.shape[0]], "w": [out.shape[1]], "c": [c], "payload": [out.tobytes()]}
        return pa.table(made, schema=pa.schema([("slide_id", pa.string()), *[(n, pa.int64()) for n in ("ty", "tx", "y0", "x0", "h", "w", "c")], ("payload", pa.binary())]))

    columns = ["slide_id", *[F.col(n).cast("bigint").alias(n) for n in ("y0", "x0", "h", "w", "c")], "payload"]
    parts = tiles.select(*columns).mapInArrow(cut, kind)
    return parts.groupBy("slide_id", "oy", "ox").applyInArrow(assemble, "slide_id string, ty bigint, tx bigint, y0 bigint, x0 bigint, h bigint, w bigint, c bigint, payload binary")
