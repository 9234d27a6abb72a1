"""What a raster source hands on: one header on the driver and a frame of encoded tiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.grid import mosaic_shape

ENCODED = "slide_id string, level int, downsample int, ty bigint, tx bigint, codec string, payload binary"
DECODED = "slide_id string, ty bigint, tx bigint, y0 bigint, x0 bigint, h bigint, w bigint, c bigint, payload binary"


@dataclass
class Slide:
    """Header of a raster; ``tiles`` are ``ENCODED``, blank ones absent or with a null payload."""

    slide_id: str
    height: int
    width: int
    channels: int
    tile_h: int
    tile_w: int
    codec: str
    color: str = "RGB"
    mpp: tuple[float, float] | None = None  # (y, x)
    downsamples: list[int] = field(default_factory=lambda: [1])
    padded: bool = True  # edge tiles are stored whole
    tiles: DataFrame | None = None
    kind: tuple[str, ...] = ()

    @property
    def mosaic(self) -> tuple[int, ...]:
        return mosaic_shape((self.height, self.width), (self.tile_h, self.tile_w))

    def level_shape(self, downsample: int) -> tuple[int, int]:
        return self.height // downsample, self.width // downsample


def decode_tiles(slide: Slide, level: int = 0) -> DataFrame:
    """``DECODED`` tiles of a level, cropped to the image; blank ones are zeros."""
    from mosaiq.functions.grid import grid

    h, w = slide.level_shape(slide.downsamples[level])
    th, tw, c, padded = slide.tile_h, slide.tile_w, slide.channels, slide.padded
    whole = grid(slide.tiles.sparkSession, h, w, th, tw)
    stored = slide.tiles.filter(F.col("level") == level).select("ty", "tx", "codec", "payload")
    joined = whole.join(stored, ["ty", "tx"], "left")
    name = slide.slide_id

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        from mosaiq.sources import codecs

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                eh, ew = r["y1"] - r["y0"], r["x1"] - r["x0"]
                if r["payload"] is None:
                    pixels = np.zeros((eh, ew, c), np.uint8)
                else:
                    shape = (th, tw, c) if padded else (eh, ew, c)
                    pixels = np.frombuffer(codecs.decode(r["codec"], r["payload"]), np.uint8).reshape(shape)[:eh, :ew]
                rows.append((name, r["ty"], r["tx"], r["y0"], r["x0"], eh, ew, c, pixels.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.string(), *[pa.int64()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in DECODED.split(", ")])

    return joined.mapInArrow(decode, DECODED)


def encode_tiles(tiles: DataFrame, slide: Slide, level: int = 0, codec_level: int | None = None) -> DataFrame:
    """``ENCODED`` tiles of ``DECODED`` ones, edge tiles padded with zeros to the whole size."""
    th, tw, codec, factor = slide.tile_h, slide.tile_w, slide.codec, slide.downsamples[level]

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        from mosaiq.sources import codecs

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pixels = np.zeros((th, tw, r["c"]), np.uint8)
                pixels[: r["h"], : r["w"]] = np.frombuffer(r["payload"], np.uint8).reshape(r["h"], r["w"], r["c"])
                rows.append((r["slide_id"], level, factor, r["ty"], r["tx"], codec, codecs.encode(codec, pixels.tobytes(), codec_level)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in ENCODED.split(", ")])

    return tiles.mapInArrow(encode, ENCODED)
