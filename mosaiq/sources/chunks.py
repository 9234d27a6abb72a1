"""A table of tiles in packs: a batch source and sink (``mosaiq_chunks``) with versions.

Each writing task appends the payloads of its tiles to packs of its own and lists them in an index beside
each. Packs bear names of their own and are seen by nobody until the driver's commit writes the next
manifest, one small file that names every pack of the version with the box of tiles it holds; a
failed job leaves the version before. A tile that is written again shadows the older one, so changing
a tile is an append, and an older version can be read as long as ``vacuum`` has not been called.

Reading is planned from the manifest alone: comparisons of slide_id, level, ty and tx leave out packs by
their boxes. A task opens each of its packs once and reads the runs of wanted tiles. One writer at a
time may commit to a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from mosaiq.functions.grid import morton
from mosaiq.sources import files

FORMAT = "mosaiq_chunks"
TILES = "slide_id string, level int, ty bigint, tx bigint, y0 bigint, x0 bigint, h bigint, w bigint, c bigint, payload binary"
KEY = ("slide_id", "level", "ty", "tx")
#: A pack is closed beyond so many bytes, and a task reads packs of about so many; batches are smaller.
PACK_BYTES, TASK_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 4 << 20
#: Runs of wanted tiles are read together if no more than this lies between them.
GAP_BYTES = 64 << 10


def _schema():
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in TILES.split(", "))])


def versions(path: str) -> list[int]:
    """Numbers of the versions that a folder has, ascending."""
    from pyarrow import fs

    system, name = files.open_fs(f"{path}/versions")
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def manifest(path: str, version: int | None = None) -> list[dict]:
    """Packs of a version (the last one) with their boxes, oldest first."""
    known = versions(path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no version" + ("" if version is None else f" {version}"))
    return json.loads(files.read_bytes(f"{path}/versions/{known[-1] if version is None else version:012d}.json"))["packs"]


def vacuum(path: str) -> None:
    """Removes what the last version does not use: older manifests, and packs of failed and of overwritten writes."""
    from pyarrow import fs

    used = {p["name"] for p in manifest(path)}
    for v in versions(path)[:-1]:
        files.remove(f"{path}/versions/{v:012d}.json")
    system, name = files.open_fs(f"{path}/packs")
    for f in system.get_file_info(fs.FileSelector(name)):
        if f.base_name.rsplit(".", 1)[0] not in used:
            system.delete_file(f.path)


@dataclass
class Written(WriterCommitMessage):
    packs: list[dict]


def slices(batch, most_bytes: int, column: str) -> Iterator:
    """Runs of a batch's rows with about ``most_bytes`` in a binary column each; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


class _Pack:
    """One pack that a task is writing."""

    def __init__(self, path: str):
        self.path, self.name = path, uuid.uuid4().hex
        system, name = files.open_fs(f"{path}/packs/{self.name}.pack")
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out, self.size, self.parts = system.open_output_stream(name), 0, []

    def add(self, batch) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch["payload"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for payload in batch["payload"]:
            self.out.write(payload.as_buffer() or b"")
        ends = self.size + np.cumsum(sizes)
        self.parts.append(pa.table([*[batch[n] for n in _schema().names[:-1]], pa.array(ends - sizes), pa.array(sizes)], [*_schema().names[:-1], "offset", "size"]))
        self.size = int(ends[-1]) if len(ends) else self.size

    def close(self) -> dict:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        self.out.close()
        index = pa.concat_tables(self.parts)
        if index.group_by(list(KEY)).aggregate([]).num_rows < index.num_rows:
            raise ValueError("a tile is written twice in one go")
        sink = pa.BufferOutputStream()
        pq.write_table(index, sink, compression="zstd")
        files.write_bytes(f"{self.path}/packs/{self.name}.index", sink.getvalue().to_pybytes())
        bounds = {n: pc.min_max(index[n]).as_py() for n in KEY}
        return {"name": self.name, "rows": index.num_rows, "bytes": self.size, "box": {n: [b["min"], b["max"]] for n, b in bounds.items()}}

    def drop(self) -> None:
        if not self.out.closed:
            self.out.close()
        for kind in ("pack", "index"):
            files.remove(f"{self.path}/packs/{self.name}.{kind}")


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, pack_bytes: int):
        self.path, self.overwrite, self.pack_bytes = path, overwrite, pack_bytes
        self.base = (versions(path) or [0])[-1]

    def write(self, iterator: Iterator) -> Written:
        done, made, pack = [], [], None
        try:
            for batch in iterator:
                for part in slices(batch, min(self.pack_bytes, BATCH_BYTES), "payload"):
                    if pack is None:
                        made.append(pack := _Pack(self.path))
                    pack.add(part)
                    if pack.size >= self.pack_bytes:
                        done.append(pack.close())
                        pack = None
            if pack is not None:
                done.append(pack.close())
        except BaseException:
            for p in made:
                p.drop()
            raise
        return Written(done)

    def commit(self, messages: list) -> None:
        if (versions(self.path) or [0])[-1] != self.base:
            raise RuntimeError(f"another write has committed to {self.path}")
        new = [{**p, "version": self.base + 1} for m in messages if m for p in m.packs]
        old = [] if self.overwrite or not self.base else manifest(self.path, self.base)
        files.publish_bytes(f"{self.path}/versions/{self.base + 1:012d}.json", json.dumps({"packs": old + new}).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            for p in m.packs if m else []:
                for kind in ("pack", "index"):
                    files.remove(f"{self.path}/packs/{p['name']}.{kind}")


@dataclass
class Planned(InputPartition):
    """Packs of one task, each with the newer packs whose boxes meet its own."""

    packs: list[tuple[str, list[str]]]


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, version: int | None, task_bytes: int):
        self.path, self.version, self.task_bytes, self.wanted = path, version, task_bytes, []

    def pushFilters(self, filters: list) -> Iterator:
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in signs and f.attribute[-1] in KEY and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], signs[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _may_hold(self, box: dict) -> bool:
        for name, sign, value in self.wanted:
            lo, hi = box[name]
            if lo is None:  # a comparison with null holds for none
                return False
            values = value if sign == "in" else [value]
            if sign in ("in", "==") and not any(v is not None and lo <= v <= hi for v in values):
                return False
            if sign in (">", ">=") and not (hi > value or sign == ">=" and hi == value) or sign in ("<", "<=") and not (lo < value or sign == "<=" and lo == value):
                return False
        return True

    def partitions(self) -> list[Planned]:
        packs = manifest(self.path, self.version)
        newer = lambda p: [q["name"] for q in packs if q["version"] > p["version"] and _meet(p["box"], q["box"])]
        tasks, size = [], 0
        for p in packs:
            if self._may_hold(p["box"]):
                if not tasks or size + p["bytes"] > self.task_bytes:
                    tasks.append([])
                    size = 0
                tasks[-1].append((p["name"], newer(p)))
                size += p["bytes"]
        return [Planned(t) for t in tasks] or [Planned([])]

    def _index(self, name: str):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        index = pq.read_table(pa.BufferReader(files.read_bytes(f"{self.path}/packs/{name}.index")))
        for column, sign, value in self.wanted:
            at = index[column]
            compared = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
            index = index.filter(pc.is_in(at, pa.array(value, at.type)) if sign == "in" else compared[sign](at, pa.scalar(value, at.type)))
        return index

    def read(self, partition: Planned) -> Iterator:
        for name, newer in partition.packs:
            index = self._index(name)
            for other in newer:
                if index.num_rows:
                    index = index.join(self._index(other).select(KEY), list(KEY), join_type="left anti")
            if not index.num_rows:
                continue
            yield from _rows(self.path, index, name)


def _rows(path: str, index, name: str) -> Iterator:
    """Batches of a pack's tiles that an index lists, by runs of the file."""
    import pyarrow as pa

    index = index.sort_by("offset").combine_chunks()
    offsets, sizes = index["offset"].to_pylist(), index["size"].to_pylist()
    system, inside = files.open_fs(f"{path}/packs/{name}.pack")
    with system.open_input_file(inside) as f:
        at = 0
        while at < len(offsets):
            to = at + 1
            while to < len(offsets) and offsets[to] - offsets[to - 1] - sizes[to - 1] <= GAP_BYTES and offsets[to] + sizes[to] - offsets[at] <= BATCH_BYTES:
                to += 1
            f.seek(offsets[at])
            run = f.read(offsets[to - 1] + sizes[to - 1] - offsets[at])
            payloads = [run[o - offsets[at] : o - offsets[at] + n] for o, n in zip(offsets[at:to], sizes[at:to], strict=True)]
            part = index.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([*[part[n].combine_chunks() for n in _schema().names[:-1]], pa.array(payloads, pa.binary())], schema=_schema())
            at = to


@dataclass
class Admitted(InputPartition):
    """Rows of one pack, by their place in its index, that a micro-batch takes."""

    name: str
    first: int
    last: int


class ChunkStream(DataSourceStreamReader):
    """Offsets count tiles over all packs, oldest first; one batch is under way at a time."""

    def __init__(self, path: str, most_tiles: int, checkpoint: str):
        if most_tiles < 1:
            raise ValueError("most_tiles has to be 1 at least")
        self.path, self.most = path, most_tiles
        self.at = self._logged(checkpoint)

    @staticmethod
    def _logged(checkpoint: str) -> int:
        """The last offset that the query planned, which it will finish first."""
        from pyarrow import fs

        system, name = files.open_fs(f"{checkpoint}/offsets")
        found = [f for f in system.get_file_info(fs.FileSelector(name, allow_not_found=True)) if f.base_name.isdigit()]
        if not found:
            return 0
        last = max(found, key=lambda f: int(f.base_name))
        with system.open_input_file(last.path) as f:
            lines = f.read().decode().splitlines()
        offsets = [json.loads(x) for x in lines[2:] if x.startswith("{")]
        return next((x["tiles"] for x in offsets if "tiles" in x), 0)

    def initialOffset(self) -> dict:
        return {"tiles": 0}

    def latestOffset(self) -> dict:
        there = sum(p["rows"] for p in manifest(self.path)) if versions(self.path) else 0
        if there < self.at:
            raise RuntimeError(f"{self.path} has been overwritten while a stream read it")
        return {"tiles": min(there, self.at + self.most)}

    def partitions(self, start: dict, end: dict) -> list[Admitted]:
        self.at = max(self.at, end["tiles"])
        made, before = [], 0
        for p in manifest(self.path) if end["tiles"] > start["tiles"] else []:
            first, last = max(0, start["tiles"] - before), min(p["rows"], end["tiles"] - before)
            if first < last:
                made.append(Admitted(p["name"], first, last))
            before += p["rows"]
        return made

    def read(self, partition: Admitted) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        index = pq.read_table(pa.BufferReader(files.read_bytes(f"{self.path}/packs/{partition.name}.index")))
        yield from _rows(self.path, index.slice(partition.first, partition.last - partition.first), partition.name)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _meet(a: dict, b: dict) -> bool:
    return all(a[n][0] is None or b[n][0] is None or a[n][0] <= b[n][1] and b[n][0] <= a[n][1] for n in KEY)


class ChunkSource(DataSource):
    """Options: path; of readers version (the last one) and task_bytes; of writers pack_bytes; of streams most_tiles and checkpoint."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> ChunkReader:
        version = self.options.get("version")
        return ChunkReader(self.options["path"], int(version) if version else None, int(self.options.get("task_bytes", TASK_BYTES)))

    def streamReader(self, schema) -> ChunkStream:
        return ChunkStream(self.options["path"], int(self.options["most_tiles"]), self.options["checkpoint"])

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], overwrite, int(self.options.get("pack_bytes", PACK_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets comparisons reach it."""
    spark.dataSource.register(ChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_chunks(tiles: DataFrame, path: str, mode: str = "errorifexists", pack_bytes: int = PACK_BYTES) -> None:
    """``TILES`` to a folder, near tiles into the same packs. Modes: errorifexists, overwrite, append.

    Append adds tiles and replaces those that are there. No tile may occur twice in ``tiles``; that is an error.
    """
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode: {mode}")
    register(tiles.sparkSession)
    if mode == "errorifexists" and versions(path):
        raise FileExistsError(path)
    named = tiles.select(*[F.col(n).cast(k) for n, k in (x.split() for x in TILES.split(", "))])
    order = ("slide_id", "level", morton(F.col("ty"), F.col("tx")), "ty", "tx")
    near = named.repartitionByRange(*order).sortWithinPartitions(*order)
    near.write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").options(path=path, pack_bytes=str(pack_bytes)).save()


def read_chunks(spark: SparkSession, path: str, version: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``TILES`` of a folder, each tile as it was written last."""
    register(spark)
    reader = spark.read.format(FORMAT).options(path=path, task_bytes=str(task_bytes))
    return (reader if version is None else reader.option("version", str(version))).load()


def stream_chunks(spark: SparkSession, path: str, most_tiles: int, checkpoint: str) -> DataFrame:
    """``TILES`` of a folder as a stream, at most so many a micro-batch; ``checkpoint`` is the query's checkpointLocation."""
    register(spark)
    return spark.readStream.format(FORMAT).options(path=path, most_tiles=str(most_tiles), checkpoint=checkpoint).load()


def read_tile(spark: SparkSession, path: str, slide_id: str, level: int, ty: int, tx: int) -> DataFrame:
    """The one tile, or no row; its pack alone is opened."""
    return read_chunks(spark, path).filter((F.col("slide_id") == slide_id) & (F.col("level") == level) & (F.col("ty") == ty) & (F.col("tx") == tx))


def read_region(spark: SparkSession, path: str, level: int, rows: slice, columns: slice, tile_h: int, tile_w: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Tiles of a level that meet the region, cut to it; only packs that hold some are opened."""
    a, b, p, q = rows.start or 0, rows.stop, columns.start or 0, columns.stop
    held = read_chunks(spark, path, task_bytes=task_bytes).filter((F.col("level") == level) & (F.col("ty") >= a // tile_h) & (F.col("tx") >= p // tile_w))
    if b is not None:
        held = held.filter(F.col("ty") <= (b - 1) // tile_h)
    if q is not None:
        held = held.filter(F.col("tx") <= (q - 1) // tile_w)

    def crop(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = []
            for t in batch.to_pylist():
                y, x = max(a, t["y0"]), max(p, t["x0"])
                y1, x1 = min(t["y0"] + t["h"], t["y0"] + t["h"] if b is None else b), min(t["x0"] + t["w"], t["x0"] + t["w"] if q is None else q)
                if y < y1 and x < x1:
                    pixels = np.frombuffer(t["payload"], np.uint8).reshape(t["h"], t["w"], t["c"])[y - t["y0"] : y1 - t["y0"], x - t["x0"] : x1 - t["x0"]]
                    made.append(t | {"y0": y, "x0": x, "h": y1 - y, "w": x1 - x, "payload": pixels.tobytes()})
            yield pa.RecordBatch.from_pylist(made, _schema())

    return held.mapInArrow(crop, TILES)
