"""Names of codecs and colour spaces, and their codes in other formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codec names, by their condensed upper-case form.
CODECS = (
    "AVIF", "Blosc", "Blosc2", "Brotli", "BZ2", "DEFLATE", "Delta", "GIF", "GZIP", "J2K", "JPEG", "JPEG 2000", "JPEG-LS", "JPEG XL", "JPEG XR", "LERC", "LJPEG",
    "LZ4", "LZ4F", "LZ77", "LZMA", "LZW", "None", "PackBits", "PNG", "QOI", "Snappy", "WebP", "ZFP", "Zlib", "ZlibNG", "Zopfli", "Zstd",
)
# Names of codecs in ISO standards.
ISO_CODECS = {"ISO_10918_1": "JPEG", "ISO_14495_1": "JPEGLS", "ISO_15444_1": "JPEG2000"}
# TIFF compression codes.
TIFF_CODECS = {
    1: "None", 5: "LZW", 7: "JPEG", 8: "DEFLATE", 22610: "JPEG XR", 32946: "DEFLATE", 33003: "JPEG 2000", 33005: "JPEG 2000", 34712: "JPEG 2000", 34926: "Zstd",
    34927: "WebP", 34933: "PNG", 34934: "JPEG XR", 50000: "Zstd", 50001: "WebP", 50002: "JPEG XL",
}
# DICOM transfer syntaxes (codec, lossless).
DICOM_SYNTAX = {
    "1.2.840.10008.1.2.4.50": ("JPEG", False),
    "1.2.840.10008.1.2.4.80": ("JPEG-LS", True),
    "1.2.840.10008.1.2.4.81": ("JPEG-LS", False),
    "1.2.840.10008.1.2.4.90": ("JPEG 2000", True),
    "1.2.840.10008.1.2.4.91": ("JPEG 2000", False),
}
# Colour spaces and other names for them.
COLORS = {
    "RGB": ("SRGB",), "RGBA": (), "Linear": (), "Grey": ("GRAY", "GREYSCALE", "GRAYSCALE", "MINISBLACK"), "Min is White": ("MINISWHITE",), "CMYK": (), "CMYKA": (),
    "YCbCr": ("BT601", "REC601"), "YCrCb": (), "YCoCg": ("YCC",), "YUV": ("BT1700",), "CIE L*a*b*": ("CIELAB",), "CIE L*u*v*": ("CIELUV",), "HSV": (), "HSL": (), "LMS": (),
    "XYB": (), "RLAB": (), "LLAB": (), "OKLab": (), "Palette": (),
}
# TIFF photometric codes, and compressions that settle the colour space.
TIFF_COLORS = {0: "Min is White", 1: "Grey", 2: "RGB", 3: "Palette", 5: "CMYK", 6: "YCbCr", 8: "CIE L*a*b*", 34892: "Linear"}
TIFF_COMPRESSION_COLORS = {33003: "YCbCr", 33005: "RGB"}
# DICOM photometric interpretations, and JPEG 2000 enumerated colour spaces.
DICOM_COLORS = {"MONOCHROME1": "Min is White", "MONOCHROME2": "Grey", "RGB": "RGB", "PALETTE_COLOR": "Palette", "YBR_FULL": "YCbCr", "YBR_FULL_422": "YCbCr", "YBR_PARTIAL_420": "YCbCr"}
JP2_COLORS = {"RGB": 16, "CMYK": 12, "Grey": 17, "YCbCr": 18}
# Ids of the codecs in the chunked-array format; "LZ77" has none.
CHUNK_CODECS = {
    "AVIF": "imagecodecs_avif", "Blosc": "blosc", "Blosc2": "imagecodecs_blosc2", "Brotli": "imagecodecs_brotli", "DEFLATE": "imagecodecs_deflate", "BZ2": "imagecodecs_bz2",
    "Delta": "delta", "GIF": "imagecodecs_gif", "GZIP": "gzip", "J2K": "imagecodecs_jpeg2k", "JPEG": "imagecodecs_jpeg", "JPEG 2000": "imagecodecs_jpeg2k", "JPEG-LS": "imagecodecs_jpegls",
    "JPEG XL": "imagecodecs_jpegxl", "JPEG XR": "imagecodecs_jpegxr", "LERC": "imagecodecs_lerc", "LJPEG": "imagecodecs_ljpeg", "LZ4": "lz4", "LZ4F": "imagecodecs_lz4f", "LZMA": "lzma",
    "LZW": "imagecodecs_lzw", "PackBits": "imagecodecs_packbits", "PNG": "imagecodecs_png", "QOI": "imagecodecs_qoi", "Snappy": "imagecodecs_snappy", "WebP": "imagecodecs_webp",
    "ZFP": "imagecodecs_zfp", "Zlib": "zlib", "ZlibNG": "imagecodecs_zlibng", "Zopfli": "imagecodecs_zopfli", "Zstd": "zstd", "None": None,
}
CLEVEL_CODECS = ("Blosc", "Delta", "GZIP", "LZ4", "LZMA", "PackBits", "Zlib", "Zstd")
LEVELLESS_CODECS = ("LZ4", "LZW", "Zstd", "QOI")


def condensed(name: str, drop: str = " -") -> str:
    return name.translate({ord(c): None for c in drop})


_CODEC_BY_NAME = {condensed(c).upper(): c for c in CODECS}
_COLOR_BY_NAME = {condensed(c, " -*").upper(): c for c in COLORS} | {other: c for c, others in COLORS.items() for other in others}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])


def codec_named(name: Column) -> Column:
    """The codec of a name in any usual spelling; null for an unknown one."""
    key = F.upper(F.translate(name, " -", ""))
    return F.element_at(_map(_CODEC_BY_NAME), F.coalesce(F.element_at(_map(ISO_CODECS), key), key))


def color_named(name: Column) -> Column:
    return F.element_at(_map(_COLOR_BY_NAME), F.upper(F.translate(name, " -*", "")))


def codec_of_tiff(code: Column) -> Column:
    return F.element_at(_map(TIFF_CODECS), code.cast("int"))


def color_of_tiff(photometric: Column, compression: Column) -> Column:
    by_compression = F.element_at(_map(TIFF_COMPRESSION_COLORS), compression.cast("int"))
    return F.coalesce(by_compression, F.element_at(_map(TIFF_COLORS), photometric.cast("int")))


def codec_of_syntax(uid: Column) -> Column:
    return F.element_at(_map({k: v[0] for k, v in DICOM_SYNTAX.items()}), uid)


def codec(name: str) -> str:
    key = condensed(name).upper()
    key = ISO_CODECS.get(key, key)
    if key not in _CODEC_BY_NAME:
        raise ValueError(f"unknown codec: {name}")
    return _CODEC_BY_NAME[key]


def color(name: str) -> str:
    key = condensed(name, " -*").upper()
    if key not in _COLOR_BY_NAME:
        raise ValueError(f"unknown colour space: {name}")
    return _COLOR_BY_NAME[key]


def transfer_syntax(name: str, lossless: bool = True) -> str:
    fitting = [u for u, (c, exact) in DICOM_SYNTAX.items() if c == name and exact in (lossless, False if name == "JPEG" else lossless)]
    if not fitting:
        raise ValueError(f"{name} has no transfer syntax here")
    return fitting[0]


def photometric(name: str, subsampling: tuple | None = (4, 2, 2)) -> str:
    if name == "RGB":
        return "RGB"
    if name == "YCbCr" and subsampling in (None, (4, 4, 4), (4, 2, 2)):
        return "YBR_FULL_422" if subsampling == (4, 2, 2) else "YBR_FULL"
    raise ValueError(f"{name} has no photometric interpretation here")


def jp2_color(name: str) -> int:
    if name not in JP2_COLORS:
        raise ValueError(f"{name} has no JPEG 2000 code")
    return JP2_COLORS[name]


def chunk_codec(name: str, level: float | None = None, dtype: str | None = None) -> dict:
    """Codec configuration of the chunked-array format."""
    if name not in CHUNK_CODECS:
        raise ValueError(f"{name} is not supported in chunks")
    made: dict = {"id": CHUNK_CODECS[name]} if CHUNK_CODECS[name] else {}
    if name == "Delta":
        made["dtype"] = "uint8"
    if name in ("J2K", "JPEG 2000"):
        made["codecformat"] = "j2k" if name == "J2K" else "jp2"
    if level is not None and name not in LEVELLESS_CODECS:
        made["clevel" if name in CLEVEL_CODECS else "level"] = level
    return made | ({"dtype": dtype} if dtype else {})
