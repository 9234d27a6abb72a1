"""What keeps a query's tasks and shuffles from growing faster than its input."""

from __future__ import annotations

import re

import pytest

from mosaiq.operators import cells as cell_ops
from mosaiq.operators import coverage, reduce, table_functions
from mosaiq.plans import fixtures as fx
from mosaiq.plans import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_layouts_are_dealt_by_bucket_and_take_repeats(spark):
    found = {(0, 0), (0, 1), (3, 2), (399, 399), (200, 7)}
    rows = [("s", 0, y, x) for y, x in sorted(found)] * 2 + [("s", 0, 400, 0), ("s", 0, 0, -1)]
    tiles = spark.createDataFrame(rows, "slide_id string, level int, ty bigint, tx bigint")
    made = coverage.missing_runs(tiles, 800, 800, 2, 2, partitions=7)
    lacking = {i for i in range(400 * 400)} - {y * 400 + x for y, x in found}
    runs = made.collect()
    assert {i for r in runs for i in range(r.first, r.last + 1)} == lacking and sum(r.last - r.first + 1 for r in runs) == len(lacking) and len(runs) == 3
    assert "REPARTITION_BY_NUM" in _plan(made) and ", 7)" in _plan(made)
    assert [tuple(r) for r in coverage.layout_summary(tiles, 800, 800, 2, 2, partitions=7).collect()] == [("s", 0, 160_000, 5, 3, False)]


@pytest.mark.parametrize("rows", [[], [(0, 0, 5), (1, 1, 6), (1, 1, 7), (9, 0, 1), (0, -1, 1)]])
def test_blanks_are_laid_out_without_a_join_with_the_grid(spark, monkeypatch, rows):
    monkeypatch.setattr(coverage, "PIECE", 5)
    tiles = spark.createDataFrame(rows, "ty bigint, tx bigint, v bigint")
    held = {r[:2] for r in rows[:3]}
    grid = {(y, x) for y in range(4) for x in range(7)}
    blank = cell_ops.blank_tiles(tiles, 8, 13, 2, 2)
    assert "Join" not in _plan(blank)
    assert sorted(map(tuple, blank.collect())) == sorted((y, x, 2 * y, min(2 * y + 2, 8), 2 * x, min(2 * x + 2, 13)) for y, x in grid - held)
    filled = cell_ops.fill_blanks(tiles, "v", 8, 13, 2, 2)
    assert "Join" not in _plan(filled)
    assert sorted(map(tuple, filled.collect())) == sorted(rows[:3] + [(y, x, 0) for y, x in grid - held])


@pytest.mark.parametrize("band, bucket, h, w", [(3, 8, 7, 13), (4, 16, 9, 8), (256, 4, 5, 6), (1, 5, 4, 4), (3, 8, 0, 4), (3, 8, 4, 0)])
def test_blanks_along_bands_are_the_grids(spark, monkeypatch, band, bucket, h, w):
    for name, value in (("BAND", band), ("BUCKET", bucket), ("PIECE", 5)):
        monkeypatch.setattr(coverage, name, value)
    held = [(y, x) for y in range(h) for x in range(w) if (3 * y + 5 * x) % 7 == 0 and y != 2]
    tiles = spark.createDataFrame(held + held[:2] + [(h, 0), (0, w), (-1, 0), (1, -2), (None, 0)], "ty int, tx int")
    for partitions in (None, 3):
        got = sorted(map(tuple, coverage.blanks(tiles, 2 * h, 2 * w, 2, 2, partitions).collect()))
        assert got == [(y, x) for y in range(h) for x in range(w) if (y, x) not in held]


def test_files_of_blanks_take_a_small_part_of_a_byte_a_tile(spark, tmp_path):
    h, w, path = 40, 40_000, tmp_path / "blank"
    tiles = spark.createDataFrame([(y, x) for y in range(5) for x in range(0, 2000, 3)], "ty bigint, tx bigint")
    cell_ops.blank_tiles(tiles, h, w, 1, 1).select("ty", "tx").write.parquet(str(path))
    n = h * w - tiles.count()
    assert spark.read.parquet(str(path)).distinct().count() == n
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < n / 2


def test_filled_tiles_shuffle_their_rows_once_and_take_little_room(spark, sf_dir, tmp_path):
    h, w, path = 40, 40_000, tmp_path / "filled"
    tiles = spark.createDataFrame([(y, x, 1 + y) for y in range(5) for x in range(0, 2000, 3)], "ty bigint, tx bigint, v bigint")
    cell_ops.fill_blanks(tiles, "v", h, w, 1, 1).write.parquet(str(path))
    filled = spark.read.parquet(str(path))
    assert filled.select("ty", "tx").distinct().count() == filled.count() == h * w
    assert sorted(map(tuple, filled.filter("v != 0").collect())) == sorted(map(tuple, tiles.collect()))
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < h * w / 2
    query = queries.QUERIES["blank_fill"](spark, sf_dir)
    query.collect()
    final = _plan(query).split("== Initial Plan ==")[0].splitlines()
    dealt = [line for line in final if "Exchange hashpartitioning(by#" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1


def test_rows_of_raster_l_are_dealt_once_by_block_to_as_many_tasks_as_they_need(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 1000)
    n = -(-fx.table(spark, sf_dir, "lineitem").count() // 1000)
    pooled = queries.QUERIES["pool_channels"](spark, sf_dir)
    assert fx.partitions_l(spark, sf_dir) == n and _plan(pooled).count("Exchange hashpartitioning") == 1 and f", {n})" in _plan(pooled)
    cells, (h, w) = fx.raster_l(spark, sf_dir), fx.extent_l(spark, sf_dir)
    by_cells = reduce.mean_pool(cells.drop("by", "bx"), 4, h, w)
    assert sorted(map(tuple, pooled.collect())) == sorted(map(tuple, by_cells.collect()))


def test_a_walk_is_dealt_by_bands_of_a_slide(spark):
    places = [(s, ty, tx) for s in "ab" for ty in range(0, 300, 7) for tx in (1, 4, 5)]
    tiles = spark.createDataFrame(places + places[:9], "slide_id string, ty bigint, tx bigint").repartition(3)
    table_functions.register(spark)
    walked = spark.sql("SELECT * FROM tile_walk(TABLE({tiles}))", tiles=table_functions.banded(tiles, 8))
    gaps = {1: 1, 4: 2, 5: 0}
    assert sorted(tuple(r) for r in walked.collect()) == [(s, ty, tx, k % 129, gaps[tx]) for k, (s, ty, tx) in enumerate(places)]
    assert re.search(r"hashpartitioning\(slide_id#\d+, band#\d+L?, 8\)", _plan(walked))
