"""Chunked arrays, version 2, in folders, zip files or SQLite files.

A level is a member ``0``, ``1``, ... of the group; a chunk file ``level/ty/tx/0`` is one tile,
padded to the whole chunk. Chunk files are independent, so executors write and read them.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.vocab import CHUNK_CODECS, chunk_codec
from mosaiq.sources import files
from mosaiq.sources.slide import ENCODED, Slide

STORES = ("dir", "ndir", "zip", "sqlite")


# Microns in the format's usual units of space; a scale without one is taken for microns.
SPACE_MICRONS = {"nanometer": 1e-3, "micrometer": 1.0, "millimeter": 1e3, "centimeter": 1e4, "meter": 1e6, "inch": 25400.0}


def _array_meta(slide: Slide, downsample: int, codec_level: int | None) -> dict:
    h, w = slide.level_shape(downsample)
    compressor = None if slide.codec == "None" else chunk_codec(slide.codec, codec_level)
    return {"zarr_format": 2, "shape": [h, w, slide.channels], "chunks": [slide.tile_h, slide.tile_w, slide.channels], "dtype": "|u1", "compressor": compressor, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"}


def attributes(slide: Slide) -> dict:
    """NGFF attributes of the pyramid; levels without a resolution have the identity."""
    steps = [{"type": "scale", "scale": [slide.mpp[0] * d, slide.mpp[1] * d, 1.0]} if slide.mpp else {"type": "identity"} for d in slide.downsamples]
    axes = [{"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}, {"name": "c", "type": "channel"}]
    return {"multiscales": [{"version": "0.4", "axes": axes, "datasets": [{"path": str(k), "coordinateTransformations": [s]} for k, s in enumerate(steps)]}], "_ARRAY_DIMENSIONS": ["y", "x", "c"], "omero": {"id": 1, "version": "0.4"}}


def _metadata(slide: Slide, codec_level: int | None) -> dict[str, bytes]:
    made = {".zgroup": {"zarr_format": 2}, ".zattrs": attributes(slide)}
    made |= {f"{k}/.zarray": _array_meta(slide, d, codec_level) for k, d in enumerate(slide.downsamples)}
    return {k: json.dumps(v).encode() for k, v in made.items()}


def write_zarr(slide: Slide, path: str, store: str = "ndir", overwrite: bool = False, codec_level: int | None = None) -> None:
    """Write the encoded tiles as they are. Single-file stores get them one after another.

    A folder is made beside its place and moved there when it is whole; a failed job leaves what was there.
    """
    if store not in STORES:
        raise ValueError(f"unknown store: {store}")
    if files.exists(path) and not overwrite:
        raise FileExistsError(path)
    metadata = _metadata(slide, codec_level)
    tiles = slide.tiles.filter("payload is not null").select("level", "ty", "tx", "payload")
    if store in ("dir", "ndir"):

        staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"

        def write(rows):
            for r in rows:
                files.write_bytes(f"{staged}/{r.level}/{r.ty}/{r.tx}/0", bytes(r.payload))

        try:
            tiles.foreachPartition(write)
            for name, data in metadata.items():
                files.write_bytes(f"{staged}/{name}", data)
        except BaseException:
            files.remove(staged)
            raise
        files.claim(path, overwrite)
        files.move(staged, path)
        return
    chunks = ((f"{r.level}/{r.ty}/{r.tx}/0", bytes(r.payload)) for r in tiles.toLocalIterator(prefetchPartitions=True))
    files.claim(path, overwrite)
    with tempfile.NamedTemporaryFile() as held:
        if store == "zip":
            with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
                for name, data in _chain(metadata.items(), chunks):
                    z.writestr(name, data)
        else:
            con = sqlite3.connect(held.name)
            con.execute("CREATE TABLE zarr (k TEXT PRIMARY KEY, v BLOB)")
            con.executemany("INSERT INTO zarr VALUES (?, ?)", _chain(metadata.items(), chunks))
            con.commit()
            con.close()
        held.seek(0)
        with open(held.name, "rb") as f:
            files.write_bytes(path, f.read())


def _chain(*parts):
    for part in parts:
        yield from part


def _store_of(path: str) -> str:
    head = b"" if files.exists(f"{path}/.zgroup") or files.exists(f"{path}/.zarray") else files.read_bytes(path, 0, 16)
    return "zip" if head.startswith(b"PK\x03\x04") else "sqlite" if head.startswith(b"SQLite format 3") else "dir"


def _entries(path: str, store: str, names: list[str] | None = None) -> dict[str, bytes]:
    """Entries of a single-file store, all or some."""
    data = files.read_bytes(path)
    if store == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n: z.read(n) for n in (z.namelist() if names is None else names)}
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return {k: v for k, v in con.execute("SELECT k, v FROM zarr") if names is None or k in names}


def read_zarr(spark: SparkSession, path: str) -> Slide:
    """Header and encoded tiles of a group, or of a bare array as its only level."""
    store = _store_of(path)
    held = _entries(path, store) if store != "dir" else None
    get = lambda n: held.get(n) if held is not None else (files.read_bytes(f"{path}/{n}") if files.exists(f"{path}/{n}") else None)
    bare = get(".zgroup") is None
    metas = [json.loads(get(".zarray"))] if bare else []
    while not bare and (found := get(f"{len(metas)}/.zarray")):
        metas.append(json.loads(found))
    if not metas:
        raise ValueError(f"no arrays in {path}")
    meta = metas[0]
    if meta["dtype"] not in ("|u1", "uint8") or not 2 <= len(meta["shape"]) <= 3:
        raise ValueError("only images of unsigned bytes with axes YX or YXC are read")
    by_id = {v: k for k, v in CHUNK_CODECS.items() if v}
    codec = by_id[meta["compressor"]["id"]] if meta["compressor"] else "None"
    attrs = json.loads(get(".zattrs") or b"{}")
    mpp = None
    for scales in attrs.get("multiscales", [])[:1]:
        for step in scales["datasets"][0]["coordinateTransformations"]:
            if step["type"] == "scale":
                names = [a["name"] for a in scales["axes"]]
                per = [step["scale"][k] * SPACE_MICRONS.get(scales["axes"][k].get("unit"), 1.0) for k in map(names.index, "yx")]
                mpp = (per[0], per[1])
    slide = Slide(path, meta["shape"][0], meta["shape"][1], meta["shape"][2] if len(meta["shape"]) == 3 else 1, meta["chunks"][0], meta["chunks"][1], codec, mpp=mpp, kind=("zarr",))
    slide.downsamples = [round(meta["shape"][0] / m["shape"][0]) for m in metas]
    separator = re.escape(meta.get("dimension_separator", "."))
    pattern = (r"(?:^|/)()" if bare else r"(?:^|/)(\d+)/") + rf"(\d+){separator}(\d+)(?:{separator}0)?$"
    if store == "dir":
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").load(path).select("path", "content")
    else:
        chunks = [n for n in held if re.search(pattern, n)]

        def fetch(rows):
            got = list(r.path for r in rows)
            yield from _entries(path, store, got).items()

        names = spark.createDataFrame([(n,) for n in chunks], "path string").repartition(max(1, len(chunks) // 256))
        found = spark.createDataFrame(names.rdd.mapPartitions(fetch), "path string, content binary")
    return _with_tiles(slide, found, pattern, codec)


def _with_tiles(slide: Slide, found: DataFrame, pattern: str, codec: str) -> Slide:
    part = lambda k: F.regexp_extract("path", pattern, k)
    level = F.coalesce(part(1).try_cast("int"), F.lit(0))
    factors = F.array(*[F.lit(d) for d in slide.downsamples])
    named = found.filter(F.col("path").rlike(pattern)).withColumn("level", level)
    slide.tiles = named.select(F.lit(slide.slide_id).alias("slide_id"), "level", F.element_at(factors, F.col("level") + 1).alias("downsample"), part(2).cast("bigint").alias("ty"), part(3).cast("bigint").alias("tx"), F.lit(codec).alias("codec"), F.col("content").alias("payload")).select(*[x.split()[0] for x in ENCODED.split(", ")])
    return slide
