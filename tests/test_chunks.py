"""The table source and sink, and what of a layout is there, against plain versions."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions.grid import morton
from mosaiq.operators import coverage
from mosaiq.sources import chunks

H, W, TH, TW = 90, 70, 8, 12


def tiles_of(spark, image, slide="s", level=0, keep=lambda ty, tx: True):
    rows = []
    for ty in range(-(-H // TH)):
        for tx in range(-(-W // TW)):
            part = image[ty * TH : (ty + 1) * TH, tx * TW : (tx + 1) * TW]
            if keep(ty, tx):
                rows.append((slide, level, ty, tx, ty * TH, tx * TW, *part.shape, bytearray(part.tobytes())))
    return spark.createDataFrame(rows, chunks.TILES).repartition(3)


def pixels(tiles):
    out = np.zeros((H, W, 2), np.uint8)
    for t in tiles.collect():
        out[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.frombuffer(bytes(t.payload), np.uint8).reshape(t.h, t.w, t.c)
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(4).integers(0, 256, (H, W, 2), np.uint8)


@pytest.fixture(scope="module")
def stored(spark, image, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks") / "a")
    chunks.write_chunks(tiles_of(spark, image), path, pack_bytes=300)
    return path


def test_round_trip_in_many_packs(spark, image, stored):
    assert len(chunks.manifest(stored)) > 10
    assert (pixels(chunks.read_chunks(spark, stored)) == image).all()
    with pytest.raises(FileExistsError):
        chunks.write_chunks(tiles_of(spark, image), stored)
    with pytest.raises(ValueError, match="mode"):
        chunks.write_chunks(tiles_of(spark, image), stored, "ignore")


def test_a_region_reads_fewer_partitions(spark, image, stored):
    whole = chunks.read_chunks(spark, stored, task_bytes=1000)
    region = chunks.read_region(spark, stored, 0, slice(10, 30), slice(15, 41), TH, TW, task_bytes=1000)
    assert region.rdd.getNumPartitions() < whole.rdd.getNumPartitions() // 2
    found = pixels(region)
    assert (found[10:30, 15:41] == image[10:30, 15:41]).all()
    found[10:30, 15:41] = 0
    assert not found.any()
    open_ended = pixels(chunks.read_region(spark, stored, 0, slice(80, None), slice(None), TH, TW))
    assert (open_ended[80:] == image[80:]).all() and not open_ended[:80].any()


def test_comparisons_reach_the_source_and_others_stay_with_spark(spark, stored):
    held = chunks.read_chunks(spark, stored, task_bytes=1)
    assert chunks.read_tile(spark, stored, "s", 0, 3, 2).rdd.getNumPartitions() < held.rdd.getNumPartitions() // 2
    conditions = ("ty = 3", "ty > 3 AND tx <= 2", "ty >= 9 AND ty < 4", "tx IN (1, 5)", "slide_id = 't'", "slide_id = 's' AND level = 0 AND ty < 2", "ty = NULL", "ty + tx = 4", "ty <> 2 AND x0 > 20", "ty = 1 OR tx = 1", "ty IN (1, NULL)")
    listed = spark.createDataFrame([(r.slide_id, r.level, r.ty, r.tx, r.y0, r.x0) for r in held.collect()], "slide_id string, level int, ty bigint, tx bigint, y0 bigint, x0 bigint")
    for condition in conditions:
        assert {(r.ty, r.tx) for r in held.filter(condition).collect()} == {(r.ty, r.tx) for r in listed.filter(condition).collect()}, condition


def test_a_changed_tile_is_a_version(spark, image, tmp_path):
    path = str(tmp_path / "v")
    chunks.write_chunks(tiles_of(spark, image), path, pack_bytes=300)
    changed = 255 - image
    chunks.write_chunks(tiles_of(spark, changed, keep=lambda ty, tx: (ty, tx) in ((2, 1), (5, 5))), path, "append")
    chunks.write_chunks(tiles_of(spark, image, keep=lambda ty, tx: (ty, tx) == (5, 5)), path, "append")
    expected = image.copy()
    expected[2 * TH : 3 * TH, TW : 2 * TW] = changed[2 * TH : 3 * TH, TW : 2 * TW]
    held = chunks.read_chunks(spark, path)
    assert held.count() == tiles_of(spark, image).count()
    assert (pixels(held) == expected).all()
    assert (pixels(chunks.read_chunks(spark, path, version=1)) == image).all()
    chunks.write_chunks(tiles_of(spark, changed), path, "overwrite")
    assert (pixels(chunks.read_chunks(spark, path)) == changed).all()
    chunks.vacuum(path)
    assert chunks.versions(path) == [4]
    assert {f.rsplit(".", 1)[0] for f in os.listdir(f"{path}/packs")} == {p["name"] for p in chunks.manifest(path)}
    assert (pixels(chunks.read_chunks(spark, path)) == changed).all()


def test_a_failed_write_leaves_the_version_before(spark, image, tmp_path):
    path = str(tmp_path / "f")
    chunks.write_chunks(tiles_of(spark, image), path)
    before = set(os.listdir(f"{path}/packs"))
    broken = tiles_of(spark, 255 - image).withColumn("h", F.when((F.col("ty") == 7) & (F.col("tx") == 3), F.raise_error(F.lit("lost"))).otherwise(F.col("h")))
    with pytest.raises(Exception, match="lost"):
        broken.repartition(4).write.format(chunks.FORMAT).mode("append").options(path=path, pack_bytes="500").save()
    assert chunks.versions(path) == [1]
    assert (pixels(chunks.read_chunks(spark, path)) == image).all()
    chunks.vacuum(path)
    assert set(os.listdir(f"{path}/packs")) == before
    twice = tiles_of(spark, image)
    with pytest.raises(Exception, match="twice"):
        chunks.write_chunks(twice.unionByName(twice), path, "append")
    assert chunks.versions(path) == [1]


def test_nothing_written_is_an_empty_version(spark, image, tmp_path):
    path = str(tmp_path / "e")
    with pytest.raises(FileNotFoundError):
        chunks.manifest(path)
    chunks.write_chunks(tiles_of(spark, image).filter("ty < 0"), path)
    assert chunks.read_chunks(spark, path).collect() == []


def test_morton_orders_as_interleaved_bits_do(spark):
    rng = np.random.default_rng(1)
    places = [(int(y), int(x)) for y, x in rng.integers(0, 2**31 - 1, (50, 2))] + [(0, 0), (1, 0), (0, 1), (3, 5)]
    plain = lambda y, x: sum((y >> k & 1) << (2 * k + 1) | (x >> k & 1) << (2 * k) for k in range(31))
    found = spark.createDataFrame(places, "y bigint, x bigint").select("y", "x", morton(F.col("y"), F.col("x")).alias("z")).collect()
    assert all(r.z == plain(r.y, r.x) for r in found)


@pytest.mark.parametrize("shape", [(1000, 900, 4, 4), (12, 9, 4, 4), (5, 5, 8, 8)])
def test_missing_runs_are_the_gaps(spark, shape):
    h, w, th, tw = shape
    down, across = -(-h // th), -(-w // tw)
    rng = np.random.default_rng(2)
    there = rng.random(down * across) < 0.3
    there[: min(40, len(there) - 1)] = False
    there[-1] = True
    places = [(level, int(k // across), int(k % across)) for level in (0, 1) for k in np.flatnonzero(there) if level == 0 or k % 2]
    tiles = spark.createDataFrame([("s", *p) for p in places * 2] + [("s", 0, -1, 0), ("s", 0, 0, across)], "slide_id string, level int, ty bigint, tx bigint")
    for level in (0, 1):
        have = {y * across + x for k, y, x in places if k == level}
        if not have:
            continue
        lack = [k for k in range(down * across) if k not in have]
        runs = {(k, next(z for z in range(k, down * across + 1) if z == down * across or z in have) - 1) for k in lack if k == 0 or k - 1 in have}
        found = coverage.missing_runs(tiles, h, w, th, tw).filter(F.col("level") == level).collect()
        assert {(r.first, r.last) for r in found} == runs and len(found) == len(runs)
        (summary,) = coverage.layout_summary(tiles, h, w, th, tw).filter(F.col("level") == level).collect()
        assert (summary.n_tiles, summary.n_present, summary.n_runs, summary.whole) == (down * across, len(have), len(runs), not lack)


def test_a_full_copy_has_every_tile(spark, image):
    some = tiles_of(spark, image, keep=lambda ty, tx: (ty + tx) % 3 == 1)
    made = coverage.full_copy(some, H, W, 2, TH, TW)
    assert made.count() == -(-H // TH) * -(-W // TW)
    assert (pixels(made) == pixels(some)).all()
    assert {(r.h, r.w) for r in made.collect()} == {(min(TH, H - y), min(TW, W - x)) for y in range(0, H, TH) for x in range(0, W, TW)}
