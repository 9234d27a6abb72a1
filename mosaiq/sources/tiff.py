"""Tiled TIFF and BigTIFF. Tiles are read by byte range on executors; the sink lays down payloads
that executors encoded, in order, with reduced levels as sub-directories of the first."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import units, vocab
from mosaiq.functions.expectations import check_resolution
from mosaiq.sources import files
from mosaiq.sources.slide import ENCODED, Slide

# Tag numbers, and the bytes and formats of field types.
TAGS = {"subfile": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "description": 270, "samples": 277, "x_res": 282, "y_res": 283, "planar": 284, "unit": 296, "predictor": 317, "tile_w": 322, "tile_h": 323, "offsets": 324, "counts": 325, "subs": 330, "jpeg_tables": 347}
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "s"), 13: (4, "I"), 16: (8, "Q"), 18: (8, "Q")}
CODES = {"None": 1, "LZW": 5, "JPEG": 7, "DEFLATE": 8, "PackBits": 32773, "JPEG 2000": 34712, "Zstd": 50000, "WebP": 50001, "JPEG XL": 50002}
PHOTOMETRIC = {"Min is White": 0, "Grey": 1, "RGB": 2, "YCbCr": 6}


class _Directory:
    def __init__(self, path: str, at: int, order: str, big: bool):
        self.path, self.order, self.big, self.fields = path, order, big, {}
        n_size, entry = (8, 20) if big else (2, 12)
        n = struct.unpack(order + ("Q" if big else "H"), files.read_bytes(path, at, n_size))[0]
        table = files.read_bytes(path, at + n_size, n * entry + (8 if big else 4))
        for k in range(n):
            raw = table[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(order + "HH", raw[:4])
            count = struct.unpack(order + ("Q" if big else "I"), raw[4 : entry - (8 if big else 4)])[0]
            self.fields[tag] = (kind, count, raw[entry - (8 if big else 4) :])
        self.next = struct.unpack(order + ("Q" if big else "I"), table[n * entry :])[0]

    def get(self, name: str, default=None):
        if TAGS[name] not in self.fields:
            return default
        kind, count, raw = self.fields[TAGS[name]]
        size, form = TYPES[kind]
        if size * count > len(raw):
            raw = files.read_bytes(self.path, struct.unpack(self.order + ("Q" if self.big else "I"), raw)[0], size * count)
        raw = raw[: size * count]
        if form == "s":
            return raw
        return list(struct.unpack(self.order + form * count if len(form) > 1 else f"{self.order}{count}{form}", raw))


def _open(path: str) -> list[_Directory]:
    """The first directory and its reduced levels."""
    head = files.read_bytes(path, 0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError(f"not a TIFF file: {path}")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    first = _Directory(path, struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0], order, big)
    return [first, *[_Directory(path, at, order, big) for at in first.get("subs", [])]]


def _resolution(page: _Directory) -> tuple[float, float] | None:
    x, y, unit = page.get("x_res"), page.get("y_res"), page.get("unit", [2])[0]
    if not x or not y or not x[0] or not y[0] or str(unit) not in units.MICRONS:
        return None
    return units.to_mpp(y[0] / y[1], unit), units.to_mpp(x[0] / x[1], unit)


def with_tables(tables: bytes | None, frame: bytes) -> bytes:
    """A JPEG frame on its own: the tables that its file keeps apart, but for their end, then the frame, but for its start."""
    return frame if not tables else tables[:-2] + frame[2:]


def read_tiff(spark: SparkSession, path: str) -> Slide:
    pages = _open(path)
    page = pages[0]
    if not page.get("tile_w"):
        raise ValueError("only tiled files are read")
    for p in pages:
        if p.get("predictor", [1])[0] != 1 or set(p.get("bits", [8])) != {8} or p.get("planar", [1])[0] != 1:
            raise ValueError("only 8-bit samples, pixel by pixel and without a predictor, are read")
    code = page.get("compression", [1])[0]
    codec = {v: k for k, v in CODES.items()}.get(code) or vocab.TIFF_CODECS.get(code)
    if codec is None:
        raise ValueError(f"unknown TIFF compression: {code}")
    color = vocab.TIFF_COMPRESSION_COLORS.get(code) or vocab.TIFF_COLORS[page.get("photometric", [1])[0]]
    h, w = page.get("height")[0], page.get("width")[0]
    slide = Slide(path, h, w, page.get("samples", [1])[0], page.get("tile_h")[0], page.get("tile_w")[0], codec, color, _resolution(page), kind=("tiff",))
    slide.downsamples = [max(1, round(h / p.get("height")[0])) for p in pages]
    places, tables = [], {}
    for level, (p, d) in enumerate(zip(pages, slide.downsamples, strict=True)):
        across = -(-p.get("width")[0] // slide.tile_w)
        if codec == "JPEG" and (found := p.get("jpeg_tables")):
            tables[level] = found
        places += [(level, d, k // across, k % across, at, n) for k, (at, n) in enumerate(zip(p.get("offsets"), p.get("counts"), strict=True)) if n]

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(path, r["level"], r["downsample"], r["ty"], r["tx"], codec, with_tables(tables.get(r["level"]), files.read_bytes(path, r["at"], r["n"]))) for r in batch.to_pylist()]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in ENCODED.split(", ")])

    frame = spark.createDataFrame(places, "level int, downsample int, ty bigint, tx bigint, at bigint, n bigint").repartition(max(1, len(places) // 256))
    slide.tiles = frame.mapInArrow(fetch, ENCODED)
    return slide


def check_tiff(slide: Slide) -> None:
    if slide.tile_h % 16 or slide.tile_w % 16:
        raise ValueError("tile sides must be multiples of 16")
    if slide.codec not in CODES:
        raise ValueError(f"{slide.codec} has no TIFF compression here")


def write_tiff(slide: Slide, path: str, overwrite: bool = False, description: str = "") -> None:
    """A BigTIFF of the encoded tiles. The driver only passes encoded bytes on, one by one."""
    check_tiff(slide)
    check_resolution(slide.mpp)
    files.claim(path, overwrite)
    system, name = files.open_fs(path)
    if "/" in name:
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    ordered = slide.tiles.filter("payload is not null").orderBy("level", "ty", "tx").select("level", "ty", "tx", "payload")
    # sizes first, so that every directory stands before the tiles and nothing is patched
    sizes = {(r.level, r.ty, r.tx): r.n for r in slide.tiles.filter("payload is not null").select("level", "ty", "tx", F.octet_length("payload").alias("n")).collect()}
    resolved = [int(round(units.to_ppu(m, 3) * 1000)) for m in slide.mpp] if slide.mpp else None

    def directory(level: int, at: int, offsets: list[int], counts: list[int], subs: list[int], after: int) -> bytes:
        h, w = slide.level_shape(slide.downsamples[level])
        fields = [
            (254, 4, "I", [1 if level else 0]), (256, 4, "I", [w]), (257, 4, "I", [h]), (258, 3, "H", [8] * slide.channels), (259, 3, "H", [CODES[slide.codec]]),
            (262, 3, "H", [PHOTOMETRIC.get(slide.color, 2) if slide.channels > 1 else 1]), (277, 3, "H", [slide.channels]), (284, 3, "H", [1]),
            (322, 4, "I", [slide.tile_w]), (323, 4, "I", [slide.tile_h]), (324, 16, "Q", offsets), (325, 16, "Q", counts),
        ]
        if description and not level:
            fields.append((270, 2, "B", list(description.encode() + b"\0")))
        if resolved:
            fields += [(282, 5, "I", [resolved[1], 1000]), (283, 5, "I", [resolved[0], 1000]), (296, 3, "H", [3])]
        if subs:
            fields.append((330, 18, "Q", subs))
        fields.sort()
        body, extra = struct.pack("<Q", len(fields)), b""
        rest = at + 8 + 20 * len(fields) + 8
        for tag, kind, form, values in fields:
            data = struct.pack(f"<{len(values)}{form}", *values)
            body += struct.pack("<HHQ", tag, kind, len(values) // 2 if kind == 5 else len(values))
            if len(data) <= 8:
                body += data.ljust(8, b"\0")
            else:
                body += struct.pack("<Q", rest + len(extra))
                extra += data + b"\0" * (len(data) % 2)
        return body + struct.pack("<Q", after) + extra

    def plan(start: int):
        """Directories that begin at ``start``, and where their tiles go."""
        grids = []
        for d in slide.downsamples:
            h, w = slide.level_shape(d)
            grids.append([(ty, tx) for ty in range(-(-h // slide.tile_h)) for tx in range(-(-w // slide.tile_w))])
        lengths, n = [], len(slide.downsamples)
        for level, cells in enumerate(grids):
            lengths.append(len(directory(level, 0, [0] * len(cells), [0] * len(cells), [0] * (n - 1) if not level else [], 0)))
        begins = [start + sum(lengths[:k]) for k in range(n)]
        at, made = start + sum(lengths), []
        for level, cells in enumerate(grids):
            counts = [sizes.get((level, *c), 0) for c in cells]
            offsets = []
            for c in counts:
                offsets.append(at if c else 0)
                at += c
            made.append(directory(level, begins[level], offsets, counts, begins[1:] if not level else [], 0))
        return b"".join(made)

    with system.open_output_stream(name) as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + plan(16))
        for r in ordered.toLocalIterator(prefetchPartitions=True):
            out.write(bytes(r.payload))
