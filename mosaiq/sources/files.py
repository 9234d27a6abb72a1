"""Files of any file system that Arrow knows, from the driver and from executors alike."""

from __future__ import annotations


def open_fs(path: str):
    """(file system, path within it) of a plain path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_bytes(path: str, offset: int = 0, size: int | None = None) -> bytes:
    system, name = open_fs(path)
    with system.open_input_file(name) as f:
        f.seek(offset)
        return f.read() if size is None else f.read(size)


def write_bytes(path: str, data: bytes) -> None:
    system, name = open_fs(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(data)


def publish_bytes(path: str, data: bytes) -> None:
    """Write a file that readers see whole or not at all."""
    system, name = open_fs(path)
    write_bytes(f"{path}.part", data)
    system.move(f"{name}.part", name)


def exists(path: str) -> bool:
    from pyarrow import fs

    system, name = open_fs(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def remove(path: str) -> None:
    from pyarrow import fs

    system, name = open_fs(path)
    kind = system.get_file_info(name).type
    if kind == fs.FileType.Directory:
        system.delete_dir(name)
    elif kind != fs.FileType.NotFound:
        system.delete_file(name)


def move(path: str, to: str) -> None:
    system, name = open_fs(path)
    system.move(name, open_fs(to)[1])


def claim(path: str, overwrite: bool) -> None:
    """A sink's output path: an error if something is there, unless it may be replaced."""
    if exists(path):
        if not overwrite:
            raise FileExistsError(path)
        remove(path)


_OWN: dict[str, str] = {}


def shared_path(spark, tag: str) -> str:
    """A path of its own in the folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where that is unset a temporary folder stands in, which only one machine's processes share.
    """
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="mosaiq-rasters-")
        _OWN["dir"] = found
    return f"{found.rstrip('/')}/mosaiq/{tag}-{uuid.uuid4().hex}"


def written(df, tag: str):
    """``df`` as Parquet in the shared folder, read back: it is made once, and no executor's loss undoes it."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
