"""Encapsulated frames of whole-slide DICOM files, explicit little-endian, with an extended
offset table that is known before anything is written."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import vocab
from mosaiq.functions.expectations import check_resolution
from mosaiq.operators.frames import frame_offsets
from mosaiq.sources import files
from mosaiq.sources.slide import ENCODED, Slide

# Identifiers of the storage class, the syntax of the file header, and this writer.
VL_WSI_STORAGE = "1.2.840.10008.5.1.4.1.1.77.1.6"
LONG_VR = (b"OB", b"OV", b"OW", b"SQ", b"UN", b"UT", b"UC", b"UR")
ITEM, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE0DD)
# Placeholders for what a slide scanner would know; callers may replace them.
DEFAULTS = {"patient_id": "anonymous", "patient_name": "anonymous", "study_uid": "2.25.1", "series_uid": "2.25.2", "instance_uid": "2.25.3", "manufacturer": "mosaiq"}


def _element(group: int, element: int, vr: bytes, value: bytes) -> bytes:
    value += (b"\0" if vr in (b"UI", b"OB", b"OV", b"OW", b"SQ") else b" ") * (len(value) % 2)
    head = struct.pack("<HH2s", group, element, vr)
    return head + (struct.pack("<HI", 0, len(value)) if vr in LONG_VR else struct.pack("<H", len(value))) + value


def dataset(slide: Slide, about: dict | None = None) -> bytes:
    """Preamble, file header and image attributes, up to the offset table."""
    about = DEFAULTS | (about or {})
    syntax = vocab.transfer_syntax(slide.codec, lossless=slide.codec != "JPEG")
    text = lambda s: str(s).encode()
    meta = _element(2, 1, b"OB", b"\0\1") + _element(2, 2, b"UI", text(VL_WSI_STORAGE)) + _element(2, 3, b"UI", text(about["instance_uid"])) + _element(2, 0x10, b"UI", text(syntax))
    spacing = "\\".join(f"{m / 1000:.10g}" for m in (slide.mpp or (1.0, 1.0)))
    short = lambda g, e, v: _element(g, e, b"US", struct.pack("<H", v))
    photometric = vocab.photometric("RGB" if slide.color == "RGB" else "YCbCr") if slide.channels == 3 else "MONOCHROME2"
    body = [
        _element(8, 0x16, b"UI", text(VL_WSI_STORAGE)), _element(8, 0x18, b"UI", text(about["instance_uid"])), _element(8, 0x60, b"CS", b"SM"), _element(8, 0x70, b"LO", text(about["manufacturer"])),
        _element(0x10, 0x10, b"PN", text(about["patient_name"])), _element(0x10, 0x20, b"LO", text(about["patient_id"])), _element(0x20, 0x0D, b"UI", text(about["study_uid"])), _element(0x20, 0x0E, b"UI", text(about["series_uid"])),
        _element(0x20, 0x9311, b"CS", b"TILED_FULL"), short(0x28, 2, slide.channels), _element(0x28, 4, b"CS", text(photometric)), *([short(0x28, 6, 0)] if slide.channels > 1 else []),
        _element(0x28, 8, b"IS", text(slide.mosaic[0] * slide.mosaic[1])), short(0x28, 0x10, slide.tile_h), short(0x28, 0x11, slide.tile_w), _element(0x28, 0x30, b"DS", text(spacing)),
        short(0x28, 0x100, 8), short(0x28, 0x101, 8), short(0x28, 0x102, 7), short(0x28, 0x103, 0),
        _element(0x48, 6, b"UL", struct.pack("<I", slide.width)), _element(0x48, 7, b"UL", struct.pack("<I", slide.height)),
    ]
    return b"\0" * 128 + b"DICM" + _element(2, 0, b"UL", struct.pack("<I", len(meta))) + meta + b"".join(body)


def write_dicom(slide: Slide, path: str, overwrite: bool = False, about: dict | None = None) -> None:
    """Frames in row-major order, as encoded; every tile of the first level is needed."""
    check_resolution(slide.mpp, required=True)
    header = dataset(slide, about)
    files.claim(path, overwrite)
    across, expected = slide.mosaic[1], slide.mosaic[0] * slide.mosaic[1]
    frames = slide.tiles.filter("level = 0 and payload is not null").select((F.col("ty") * across + F.col("tx")).alias("i"), F.octet_length("payload").cast("bigint").alias("len"), "payload")
    table = frame_offsets(frames.select("i", "len")).orderBy("i").select("byte_offset", "padded_len").collect()
    if len(table) != expected:
        raise ValueError(f"{expected} frames are needed, and {len(table)} were given")
    offsets = struct.pack(f"<{expected}Q", *[r.byte_offset for r in table])
    lengths = struct.pack(f"<{expected}Q", *[r.padded_len for r in table])
    system, name = files.open_fs(path)
    if "/" in name:
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(header + _element(0x7FE0, 1, b"OV", offsets) + _element(0x7FE0, 2, b"OV", lengths))
        out.write(struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + struct.pack("<HHI", *ITEM, 0))
        for r in frames.orderBy("i").toLocalIterator(prefetchPartitions=True):
            payload = bytes(r.payload)
            payload += b"\0" * (len(payload) % 2)
            out.write(struct.pack("<HHI", *ITEM, len(payload)) + payload)
        out.write(struct.pack("<HHI", *SEQUENCE_END, 0))


def _elements(data: bytes):
    """(tag, value, end) of the top-level elements before the pixel data."""
    at = 132
    while at + 8 <= len(data):
        group, element, vr = struct.unpack("<HH2s", data[at : at + 6])
        long = vr in LONG_VR
        size = struct.unpack("<I", data[at + 8 : at + 12])[0] if long else struct.unpack("<H", data[at + 6 : at + 8])[0]
        at += 12 if long else 8
        if (group, element) == (0x7FE0, 0x10):
            yield (group, element), b"", at
            return
        yield (group, element), data[at : at + size], at + size
        at += size


def read_dicom(spark: SparkSession, path: str) -> Slide:
    data = files.read_bytes(path)
    if data[128:132] != b"DICM":
        raise ValueError(f"not a DICOM file: {path}")
    found = {tag: (value, end) for tag, value, end in _elements(data)}
    short = lambda *tag: struct.unpack("<H", found[tag][0])[0]
    text = lambda *tag: found[tag][0].decode().strip(" \0")
    syntax = text(2, 0x10)
    if syntax not in vocab.DICOM_SYNTAX:
        raise ValueError(f"unknown transfer syntax: {syntax}")
    width, height = (struct.unpack("<I", found[0x48, e][0])[0] for e in (6, 7))
    spacing = [float(s) * 1000 for s in text(0x28, 0x30).split("\\")]
    slide = Slide(path, height, width, short(0x28, 2), short(0x28, 0x10), short(0x28, 0x11), vocab.DICOM_SYNTAX[syntax][0], vocab.DICOM_COLORS[text(0x28, 4)], (spacing[0], spacing[1]), kind=("dicom",))
    frames = int(text(0x28, 8))
    if frames != slide.mosaic[0] * slide.mosaic[1]:
        raise ValueError(f"{frames} frames do not fill {slide.mosaic}")
    begin = found[0x7FE0, 0x10][1]
    begin += 8 + struct.unpack("<I", data[begin + 4 : begin + 8])[0]  # beyond the basic table
    offsets = struct.unpack(f"<{frames}Q", found[0x7FE0, 1][0])
    lengths = struct.unpack(f"<{frames}Q", found[0x7FE0, 2][0])
    places = [(k // slide.mosaic[1], k % slide.mosaic[1], begin + o + 8, n) for k, (o, n) in enumerate(zip(offsets, lengths, strict=True))]
    codec = slide.codec

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(path, 0, 1, r["ty"], r["tx"], codec, files.read_bytes(path, r["at"], r["n"])) for r in batch.to_pylist()]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in ENCODED.split(", ")])

    slide.tiles = spark.createDataFrame(places, "ty bigint, tx bigint, at bigint, n bigint").repartition(max(1, frames // 256)).mapInArrow(fetch, ENCODED)
    return slide
