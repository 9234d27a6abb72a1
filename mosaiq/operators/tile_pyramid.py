"""Pyramids of packed tiles: each base tile is reduced where it lies, and parents are put together in Z-order.

Tiles are dealt to tasks by ranges of the Z-order curve and walked along it, so the tiles of a parent
follow each other. A task reduces a tile to its part of each level, and writes a parent as soon as its
last part has come. Only parents that a range's edge cuts, or that lack tiles, leave as parts;
these alone are shuffled again. Tile sides must be multiples of the largest downsample, so that no
block crosses a tile; where they are not, ``mosaiq.operators.pyramid`` works on cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.grid import morton
from mosaiq.operators.cells import TILE
from mosaiq.sources import files

LEVELS = f"level int, downsample bigint, {TILE}, whole boolean"
#: Parents that a task keeps open; beyond these the oldest leaves in parts.
OPEN = 256


def divides(factors: list[int], tile_h: int, tile_w: int) -> bool:
    """Whether tiles of these sides can be reduced on their own."""
    return not factors or not any(tile_h % f or tile_w % f for f in factors)


def _record(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in LEVELS.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _reducer(factors: list[int], tile_h: int, tile_w: int, h: int, w: int, cascade: bool):
    down, across = -(-h // tile_h), -(-w // tile_w)

    def parts_of(pixels):
        """(downsample, truncated block means) of each level that the tile has a cell of."""
        import numpy as np

        below, before = pixels, 1
        for f in factors:
            source, step = (below, f // before) if cascade else (pixels, f)
            rows, cols = source.shape[0] // step, source.shape[1] // step
            if not rows or not cols:
                return
            sums = source[: rows * step, : cols * step].reshape(rows, step, cols, step, -1).sum(axis=(1, 3), dtype=np.int64)
            below, before = (sums // (step * step)).astype(np.uint8), f
            yield f, below

    def expected(f: int, ty: int, tx: int) -> int:
        """Tiles that a parent has a part of."""
        span = lambda at, n, extent, side: sum(1 for k in range(at * f, min((at + 1) * f, n)) if min(side, extent - k * side) >= f)
        return span(ty, down, h, tile_h) * span(tx, across, w, tile_w)

    def reduce_tiles(batches):
        import numpy as np

        waiting: dict[tuple, list] = {}

        def row(key, y, x, pixels, whole):
            slide, f, ty, tx = key
            return (factors.index(f) + 1, f, slide, ty, tx, y, x, *pixels.shape, pixels.tobytes(), whole)

        for batch in batches:
            made = []
            for t in batch.to_pylist():
                pixels = np.frombuffer(t["payload"], np.uint8).reshape(t["h"], t["w"], t["c"])
                for f, part in parts_of(pixels):
                    key = (t["slide_id"], f, t["ty"] // f, t["tx"] // f)
                    held = waiting.setdefault(key, [])
                    held.append((t["y0"] // f, t["x0"] // f, part))
                    if len(held) == expected(f, *key[2:]):
                        y0, x0 = key[2] * tile_h, key[3] * tile_w
                        whole = np.zeros((min(tile_h, h // f - y0), min(tile_w, w // f - x0), t["c"]), np.uint8)
                        for y, x, p in waiting.pop(key):
                            whole[y - y0 : y - y0 + p.shape[0], x - x0 : x - x0 + p.shape[1]] = p
                        made.append(row(key, y0, x0, whole, True))
                while len(waiting) > OPEN:
                    oldest = next(iter(waiting))
                    made += [row(oldest, *p, False) for p in waiting.pop(oldest)]
            yield _record(made)
        yield _record([row(key, *p, False) for key, held in waiting.items() for p in held])

    return reduce_tiles


def tile_pyramid(tiles: DataFrame, factors: list[int], tile_h: int, tile_w: int, h: int, w: int, cascade: bool = True) -> DataFrame:
    """(level, downsample, ``TILE``) of every level above the base tiles (``TILE``), in tiles of the same sides.

    ``cascade``: each level from the one before, else from the base. Tiles that are missing are zeros
    in parents that have others.
    """
    before = 1
    for f in factors:
        if f <= before or cascade and f % before:
            raise ValueError(f"downsamples must be growing multiples of each other: {factors}")
        before = f
    if not divides(factors, tile_h, tile_w):
        raise ValueError(f"tiles of {tile_h} by {tile_w} are no multiples of {factors}")
    names = [x.split()[0] for x in TILE.split(", ")]
    order = ("slide_id", morton(F.col("ty"), F.col("tx")))
    walked = tiles.select(*[F.col(n).cast(k) for n, k in (x.split() for x in TILE.split(", "))]).repartitionByRange(*order).sortWithinPartitions(*order)
    made = files.written(walked.mapInArrow(_reducer(factors, tile_h, tile_w, h, w, cascade), LEVELS), "pyramid")

    def join_parts(table):
        import numpy as np
        import pyarrow as pa

        rows = table.to_pylist()
        r = rows[0]
        y0, x0 = r["ty"] * tile_h, r["tx"] * tile_w
        whole = np.zeros((min(tile_h, h // r["downsample"] - y0), min(tile_w, w // r["downsample"] - x0), r["c"]), np.uint8)
        for p in rows:
            whole[p["y0"] - y0 : p["y0"] - y0 + p["h"], p["x0"] - x0 : p["x0"] - x0 + p["w"]] = np.frombuffer(p["payload"], np.uint8).reshape(p["h"], p["w"], p["c"])
        return pa.Table.from_batches([_record([(r["level"], r["downsample"], r["slide_id"], r["ty"], r["tx"], y0, x0, *whole.shape, whole.tobytes(), True)])])

    joined = made.filter("NOT whole").groupBy("slide_id", "level", "ty", "tx").applyInArrow(join_parts, LEVELS)
    return made.filter("whole").unionByName(joined).select("level", "downsample", *names)
