"""Lossless codecs that the environment has; payloads of others stay as they are."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib


def _packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n != 128 else 1
    return bytes(out)


def _packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and data[at + run : at + run + 1] == data[at : at + 1]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
        else:
            stop = at + 1
            while stop < len(data) and stop - at < 128 and data[stop : stop + 1] != data[stop + 1 : stop + 2]:
                stop += 1
            out += bytes((stop - at - 1,)) + data[at:stop]
            at = stop
    return bytes(out)


def _lzw_decode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first; a clear code is 256, the end 257."""
    out, bits, n_bits, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    before = b""
    for byte in data:
        bits, n_bits = bits << 8 | byte, n_bits + 8
        if n_bits < width:
            continue
        n_bits -= width
        code, bits = bits >> n_bits, bits & ((1 << n_bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def _zstd(data: bytes, level: int | None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)


def _zstd_decode(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def _refuse(*_):
    raise ValueError("this codec is not available; its payloads can only be passed through")


ENCODE = {
    "None": lambda d, level: d,
    "DEFLATE": lambda d, level: zlib.compress(d, 6 if level is None else level),
    "Zlib": lambda d, level: zlib.compress(d, 6 if level is None else level),
    "GZIP": lambda d, level: gzip.compress(d, 6 if level is None else level, mtime=0),
    "BZ2": lambda d, level: bz2.compress(d, 9 if level is None else level),
    "LZMA": lambda d, level: lzma.compress(d, preset=level),
    "Zstd": _zstd,
    "PackBits": lambda d, level: _packbits_encode(d),
}
DECODE = {
    "None": bytes,
    "DEFLATE": zlib.decompress,
    "Zlib": zlib.decompress,
    "GZIP": gzip.decompress,
    "BZ2": bz2.decompress,
    "LZMA": lzma.decompress,
    "Zstd": _zstd_decode,
    "PackBits": _packbits_decode,
    "LZW": _lzw_decode,
}


#: A session's setting that names a codec's functions, as module:encode and module:decode.
SETTING = "spark.mosaiq.codec."


def register(spark, name: str, encode: str | None, decode: str | None, module_files: tuple[str, ...] = ()) -> None:
    """Makes a codec known to a session and, with it, to the executors that work for it.

    Functions are named as ``module:function``, of (bytes, level) and of bytes; they are looked up where they are
    needed. ``module_files`` are sent to the executors, unless these have the modules anyway.
    """
    for which in filter(None, (encode, decode)):
        if which.count(":") != 1:
            raise ValueError(f"codec {name}: {which} is not module:function")
    for file in module_files:
        spark.sparkContext.addPyFile(file)
    spark.conf.set(f"{SETTING}{name}", f"{encode or ''},{decode or ''}")


def _setting(codec: str) -> str | None:
    """In a task what its session has set, on the driver what the active session has."""
    from pyspark import TaskContext

    context = TaskContext.get()
    if context is not None:
        return context.getLocalProperty(f"{SETTING}{codec}")
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    return session.conf.get(f"{SETTING}{codec}", None) if session else None


def _resolve(codec: str, which: int):
    import importlib

    named = (_setting(codec) or ",").split(",")[which]
    if not named:
        return None
    module, function = named.split(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"codec {codec}: {named} is not to be found here") from e


def encode(codec: str, data: bytes, level: int | None = None) -> bytes:
    return (ENCODE.get(codec) or _resolve(codec, 0) or _refuse)(data, level)


def decode(codec: str, data: bytes) -> bytes:
    return (DECODE.get(codec) or _resolve(codec, 1) or _refuse)(data)


def can_decode(codec: str) -> bool:
    return codec in DECODE or bool((_setting(codec) or ",").split(",")[1])
