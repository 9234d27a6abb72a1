"""The four commands as plans: convert, transcode, thumbnail, identify."""

from __future__ import annotations

import struct
import zlib
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import grid, magic
from mosaiq.operators import cells as cell_ops
from mosaiq.operators import pyramid, regrid, resample, tile_pyramid
from mosaiq.sources import codecs, dicom, files, tiff, zarr
from mosaiq.sources.slide import Slide, decode_tiles, encode_tiles

#: Writers by suffix; two suffixes are tried before the last one.
SUFFIXES = {".ome.tiff": "tiff", ".zarr.zip": "zarr", ".tiff": "tiff", ".tif": "tiff", ".zarr": "zarr", ".ngff": "zarr", ".zip": "zarr", ".dcm": "dicom", ".sqlite": "zarr"}


def identify(path: str) -> list[str]:
    """Types of a file or directory, as ``a/b``; the driver reads a header only."""
    if files.exists(f"{path}/.zgroup"):
        return ["zarr", "zarr/group"]
    if files.exists(f"{path}/.zarray"):
        return ["zarr", "zarr/array"]
    return ["/".join(t) for t in magic.types_of(files.read_bytes(path, 0, magic.HEADER_BYTES))]


def open_slide(spark: SparkSession, path: str) -> Slide:
    kinds = identify(path)
    for kind, reader in (("tiff", tiff.read_tiff), ("dcm", dicom.read_dicom), ("zarr", zarr.read_zarr), ("zip", zarr.read_zarr), ("sqlite3", zarr.read_zarr)):
        if kind in kinds:
            return reader(spark, path)
    raise ValueError(f"no reader for {path} ({', '.join(kinds) or 'unknown type'})")


def writer_of(path: str, writer: str | None = None) -> str:
    if writer:
        if writer not in ("tiff", "zarr", "dicom"):
            raise ValueError(f"unknown writer: {writer}")
        return writer
    lowered = path.lower().rstrip("/").rsplit("/", 1)[-1]
    if lowered.endswith((".ome.tiff", ".ome.tif")):
        raise ValueError("OME metadata cannot be written; name the output .tiff, or give the writer")
    for suffix in sorted(SUFFIXES, key=lambda s: -s.count(".")):
        if lowered.endswith(suffix):
            return SUFFIXES[suffix]
    raise ValueError(f"no writer for {path}")


def _write(slide: Slide, path: str, writer: str | None, store: str | None, overwrite: bool, codec_level: int | None = None) -> None:
    kind = writer_of(path, writer)
    if kind == "tiff":
        tiff.write_tiff(slide, path, overwrite)
    elif kind == "dicom":
        dicom.write_dicom(slide, path, overwrite)
    else:
        by_suffix = "zip" if path.lower().endswith(".zip") else "sqlite" if path.lower().endswith(".sqlite") else "ndir"
        zarr.write_zarr(slide, path, store or by_suffix, overwrite, codec_level)


def convert(spark: SparkSession, source: str, target: str, tile: tuple[int, int] = (256, 256), codec: str = "DEFLATE", codec_level: int | None = None, downsamples: list[int] | None = None, mpp: tuple[float, float] | None = None, cascade: bool | None = None, writer: str | None = None, store: str | None = None, overwrite: bool = False) -> Slide:
    """Decode, re-grid, re-encode and write with reduced levels; ``tile`` is (height, width).

    Levels come from the one before in chunked arrays and from the base elsewhere, or as told.
    """
    read = open_slide(spark, source)
    kind = writer_of(target, writer)
    codec = "Zlib" if kind == "zarr" and codec == "DEFLATE" else codec
    levels = [1, *(downsamples or [])]
    cascade = kind == "zarr" if cascade is None else cascade
    for before, after in zip(levels, levels[1:], strict=False):
        if after <= before or cascade and after % before:
            raise ValueError(f"downsamples must be growing multiples: {downsamples}")
    made = replace(read, tile_h=tile[0], tile_w=tile[1], codec=codec, mpp=mpp or read.mpp, downsamples=levels, padded=True)
    if kind == "tiff":
        tiff.check_tiff(made)
    base = decode_tiles(read).persist()
    try:
        same = (read.tile_h, read.tile_w) == tile
        first = base if same else regrid.regrid_tiles(base, *tile, read.height, read.width)
        made.tiles = encode_tiles(first, made, 0, codec_level)
        if tile_pyramid.divides(levels[1:], *tile):
            above = tile_pyramid.tile_pyramid(first, levels[1:], *tile, read.height, read.width, cascade) if levels[1:] else None
            reduced = [above.filter(F.col("level") == k).drop("level", "downsample") for k in range(1, len(levels))]
        else:
            cells = cell_ops.tiles_to_cells(base).drop("slide_id")
            stacked = (pyramid.cascade if cascade else pyramid.direct)(cells, levels[1:], read.height, read.width).withColumn("slide_id", F.lit(read.slide_id))
            reduced = [cell_ops.cells_to_tiles(stacked.filter(F.col("downsample") == f), *tile, *read.level_shape(f), read.channels) for f in levels[1:]]
        for k, level in enumerate(reduced, 1):
            made.tiles = made.tiles.unionByName(encode_tiles(level, made, k, codec_level))
        _write(made, target, writer, store, overwrite, codec_level)
    finally:
        base.unpersist()
    return made


def can_transcode(slide: Slide, target: str) -> bool:
    """Whether encoded tiles may pass as they are."""
    return slide.kind[:1] in (("tiff",), ("dicom",)) and (target != "dicom" or slide.codec in ("JPEG", "JPEG 2000", "JPEG-LS")) and (target != "tiff" or slide.codec in tiff.CODES) and (target != "zarr" or slide.codec not in ("LZ77",))


def transcode(spark: SparkSession, source: str, target: str, store: str | None = None, overwrite: bool = False) -> Slide:
    """Write the payloads of the first level unchanged into another container."""
    slide = open_slide(spark, source)
    kind = writer_of(target)
    if not can_transcode(slide, kind):
        raise ValueError(f"{slide.codec} tiles of {source} cannot pass into {target} as they are")
    made = replace(slide, downsamples=[1], tiles=slide.tiles.filter("level = 0"))
    _write(made, target, None, store, overwrite)
    return made


def thumbnail_array(slide: Slide, shape: tuple[int, int], kernel: str | None = "bicubic"):
    """An image of the shape: block means by the largest factor that stays above it, then a resize.

    Means and weights are applied on the executors; what reaches the driver is the thumbnail's cells.
    """
    import numpy as np

    factor = max(1, min(slide.height // max(1, shape[0]), slide.width // max(1, shape[1]), slide.tile_h, slide.tile_w))
    tiles = decode_tiles(slide)
    means = cell_ops.pool_tiles(tiles, factor, slide.tile_h, slide.tile_w)
    (h, w), _ = grid.block_downsample_shape((slide.height, slide.width), factor, (slide.tile_h, slide.tile_w))
    cells = cell_ops.tiles_to_cells(means).drop("slide_id")
    (to_h, to_w) = (h, w) if kernel is None else shape
    made = cells if kernel is None else resample.resize(cells, h, w, to_h, to_w, kernel)
    out = np.zeros((to_h, to_w, slide.channels), np.uint8)
    for r in made.groupBy("y").agg(F.collect_list(F.struct("x", "c", "v")).alias("cells")).toLocalIterator():
        for x, c, v in r.cells:
            out[r.y, x, c] = v
    return out


def png(image) -> bytes:
    """An 8-bit image as PNG."""
    h, w, c = image.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def thumbnail(spark: SparkSession, source: str, target: str, size: tuple[int, int] | None = None, downsample: int | None = None, approximate: bool = False, overwrite: bool = False) -> None:
    """PNG of a (height, width) or of a downsample, one of which is needed."""
    if (size is None) == (downsample is None):
        raise ValueError("either a size or a downsample is needed")
    slide = open_slide(spark, source)
    if not codecs.can_decode(slide.codec):
        raise ValueError(f"{slide.codec} cannot be decoded here")
    shape = size or (max(1, slide.height // downsample), max(1, slide.width // downsample))
    files.claim(target, overwrite)
    files.write_bytes(target, png(thumbnail_array(slide, shape, None if approximate else "bicubic")))
