"""Streams: ordered release with its state and timers, and tiles from packs in bounded batches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from mosaiq.sources import chunks
from mosaiq.streaming.reorder import release_in_order

TILE = "slide_id string, k bigint, payload binary, n_tiles bigint"


def _feed(spark, path, rows):
    spark.createDataFrame([(s, k, bytearray([k % 256]), n) for s, k, n in rows], TILE).coalesce(1).write.mode("append").parquet(str(path))


def _start(spark, tmp_path, stream, name):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()


def _until(running, done, seconds=40):
    """A query with processing-time timers always has another batch to run, so its end is waited for by what is seen."""
    began = time.time()
    while not done() and running.isActive and time.time() < began + seconds:
        time.sleep(0.3)
    if not running.isActive:
        running.awaitTermination(1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_slides_leave_in_order_and_nothing_of_them_stays(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, k, n) for s, n in (("a", 9), ("b", 5), ("c", 1)) for k in range(n)]
    rng.shuffle(rows)
    repeated = [r for r in rows if r[0] == "a" and r[1] < 3]
    for k in range(0, len(rows), 5):
        _feed(spark, tmp_path / "in", rows[k : k + 5] + (repeated if k == 0 else []))
    stream = spark.readStream.schema(TILE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = _start(spark, tmp_path, release_in_order(stream, 600_000), "in_order")
    try:
        _until(running, lambda: spark.table("in_order").count() >= 15)
    finally:
        running.stop()
    found = spark.table("in_order").collect()
    for s, n in (("a", 9), ("b", 5), ("c", 1)):
        assert [(r.k, r.place, bytes(r.payload)) for r in found if r.slide_id == s] == [(k, k, bytes([k])) for k in range(n)]
    for variable in ("following", "waiting"):
        held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", variable)
        assert held.load().count() == 0, variable


def test_a_slide_without_an_end_keeps_one_number(spark, tmp_path):
    _feed(spark, tmp_path / "in", [("a", k, None) for k in (0, 2, 1, 5)])
    stream = spark.readStream.schema(TILE).parquet(str(tmp_path / "in")).drop("n_tiles")
    running = _start(spark, tmp_path, release_in_order(stream), "no_end")
    try:
        running.processAllAvailable()
        _feed(spark, tmp_path / "in", [("a", k, None) for k in (1, 3)])
        running.processAllAvailable()
    finally:
        running.stop()
    assert [r.k for r in spark.table("no_end").orderBy("place").collect()] == [0, 1, 2, 3]
    state = lambda v: spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", v).load()
    assert [r.value.k for r in state("following").collect()] == [4]
    assert [r.user_map_key.k if hasattr(r, "user_map_key") else r.key.k for r in state("waiting").collect()] == [5]


def test_a_tile_that_does_not_come_ends_the_query(spark, tmp_path):
    _feed(spark, tmp_path / "in", [("a", 1, 4)])
    stream = spark.readStream.schema(TILE).parquet(str(tmp_path / "in"))
    running = _start(spark, tmp_path, release_in_order(stream, 300), "late")
    with pytest.raises(Exception, match="tile 0 has not arrived"):
        _until(running, lambda: False)
    running.stop()


def _tiles(spark, ids):
    one = F.lit(1).cast("bigint")
    held = spark.createDataFrame([(k,) for k in ids], "id bigint")
    return held.select(F.lit("s").alias("slide_id"), F.lit(0).alias("level"), (F.col("id") / 8).cast("bigint").alias("ty"), (F.col("id") % 8).alias("tx"), *[one.alias(n) for n in ("y0", "x0", "h", "w", "c")], F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))


def test_no_batch_passes_the_bound_and_a_restart_repeats_nothing(spark, tmp_path):
    path, checkpoint = str(tmp_path / "tiles"), str(tmp_path / "cp")
    chunks.write_chunks(_tiles(spark, range(40)), path, pack_bytes=20)
    sizes, got = [], []

    def run(fail_after=None):
        def take(batch, batch_id):
            if fail_after is not None and len(sizes) >= fail_after:
                raise RuntimeError("stopped here")
            rows = [int(bytes(r.payload)) for r in batch.collect()]
            sizes.append(len(rows))
            got.extend(rows)

        stream = chunks.stream_chunks(spark, path, 7, checkpoint)
        running = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()

    with pytest.raises(Exception, match="stopped here"):
        run(fail_after=3)
    run()
    assert sizes == [7, 7, 7, 7, 7, 5]
    assert sorted(got) == list(range(40))
    # what is written later comes later, by the same bound, and so does a tile that is written again
    chunks.write_chunks(_tiles(spark, [3, *range(40, 49)]), path, "append")
    run()
    assert sizes[6:] == [7, 3] and sorted(got[40:]) == [3, *range(40, 49)]
    run()
    assert len(sizes) == 8


def test_a_stream_needs_a_bound(spark, tmp_path):
    with pytest.raises(ValueError, match="most_tiles"):
        chunks.ChunkStream(str(tmp_path), 0, str(tmp_path))
    empty = chunks.ChunkStream(str(tmp_path / "none"), 5, str(tmp_path / "cp"))
    assert empty.latestOffset() == {"tiles": 0} and empty.partitions({"tiles": 0}, {"tiles": 0}) == []


def test_what_can_leave_in_its_batch_never_touches_the_state():
    import pandas as pd

    from mosaiq.streaming.reorder import Reorder

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, v: setattr(self, "held", v)
        clear = lambda self: setattr(self, "held", None)

    class Waiting(dict):
        touched = 0

        def containsKey(self, k):
            self.touched += 1
            return k in self

        def updateValue(self, k, v):
            self.touched += 1
            self[k] = v

        def getValue(self, k):
            return self[k]

        def removeKey(self, k):
            del self[k]

    made = Reorder(-1)
    made.following, made.waiting = Value(), Waiting()
    ks = random.Random(5).sample(range(1000), 1000)
    frame = lambda ks, mark=b"": pd.DataFrame({"k": ks, "payload": [mark + b"%d" % k for k in ks], "n_tiles": [None] * len(ks)})
    out = pd.concat(made.handleInputRows(("a",), iter([frame([3], b"old"), frame(ks)]), None))
    assert list(out["k"]) == list(out["place"]) == list(range(1000)) and list(out["payload"]) == [b"%d" % k for k in range(1000)]
    assert made.waiting.touched == 0 and made.following.held == (1000,)
    assert not list(made.handleInputRows(("a",), iter([frame([1001, 1003, 1004, 7])]), None)) and sorted(made.waiting) == [(1001,), (1003,), (1004,)]
    out = pd.concat(made.handleInputRows(("a",), iter([frame([1000, 1002, 1003], b"new")]), None))
    assert list(out["payload"]) == [b"new1000", b"1001", b"new1002", b"new1003", b"1004"] and not made.waiting
