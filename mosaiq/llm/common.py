"""Helpers that the training-data operators share: shared storage, splits, sizes."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the setting is absent, as in local tests, a temporary folder of this process
    stands in for it; as that is only sound within one process, a cluster without it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="mosaiq-shared-")
    return _OWN["dir"]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; ``clear_shared`` removes what stands there."""
    _WRITTEN.append(path := f"{shared_dir(spark)}/mosaiq/{tag}-{uuid.uuid4().hex}")
    return path


def clear_shared(spark: SparkSession) -> None:
    """Removes all tables that this process has cut lineages with; their frames end with them."""
    while _WRITTEN:
        remove_path(spark, _WRITTEN.pop())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """On leaving, removes the tables written within but those given to ``keep``; nothing may read them later."""
    before, kept = len(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["mosaiq_path"])
        return df

    yield keep
    release_shuffles(spark)
    inside, _WRITTEN[before:] = _WRITTEN[before:], [p for p in _WRITTEN[before:] if p in kept]
    for path in inside:
        if path not in kept:
            remove_path(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage.

    Nothing here depends on an executor's own disk, so later stages survive its loss.
    """
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.__dict__["mosaiq_path"] = path
    return made


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after a lineage was cut.
    This process gives its own freed memory back, too.
    """
    gc.collect()
    trim_memory()
    spark.sparkContext._jvm.System.gc()


def settle_shuffles(spark: SparkSession) -> None:
    """Lets the shuffle files of all jobs so far go, those of the last one too.

    Spark holds on to its last job until another follows, so an empty one does; its cleaner gets a second.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    release_shuffles(spark)
    time.sleep(1)


def trim_memory() -> None:
    """Give freed memory back to the system, which the driver and reused workers else keep.

    Encoders go too, with the words' ids that they keep: what calls this does not tokenise.
    """
    import ctypes

    import pyarrow as pa

    tokens = sys.modules.get("mosaiq.llm.tokens")
    if tokens and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        gc.collect()  # an encoder and its caches refer to each other
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        return


def held_out(doc_id: Column, modulus: int) -> Column:
    """The fixed split of the contracts: crc32 of the id as text leaves 2. A null id learns."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus) == 2, F.lit(False))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over the whole table; one number reaches the driver."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
