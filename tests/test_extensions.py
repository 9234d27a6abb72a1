"""Expectations, reducers and codecs of the caller's own, and table functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import expectations as ex
from mosaiq.operators import reducers, table_functions
from mosaiq.sources import chunks, codecs
from mosaiq.sources.slide import Slide, decode_tiles, encode_tiles

HEADERS = "id int, tile_h int, tile_w int, mpp_y double, mpp_x double, codec string, read_tile_h int, read_tile_w int, downsamples array<int>, size array<int>, tile array<int>, ppu_y double, ppu_x double, unit int"


def _headers(spark):
    return spark.createDataFrame(
        [
            (1, 16, 32, 0.5, 0.25, "JPEG", 32, 64, [2, 4, 8], [9, 9], [1, 1], 40.0, 40.0, 3),
            (2, 24, 32, 1000.0, 0.25, "JPEG", 32, 64, [2, 8], [9, 9, 3], [1, 1], 72.0, 40.0, 2),
            (3, 16, 16, None, None, None, 16, 16, [], [9, 9], [1, 1], 72.0, 0.0, 3),
            (4, 16, 16, 25400 / 300, 0.5, "Zstd", 24, 24, None, None, [1, 1], None, None, None),
        ],
        HEADERS,
    )


def test_rules_judge_each_row(spark):
    rules = {r.name: r for made in (ex.tiff_rules, ex.dicom_rules, ex.pyramid_rules, ex.lossy_rules, ex.resolution_tag_rules) for r in made()}
    found = {r.id: {n for n in rules if not r[n]} for r in ex.verdicts(_headers(spark), list(rules.values()), ["id"]).collect()}
    # null says nothing against a row, but an absent resolution is told
    assert found == {1: set(), 2: {"tile_sides", "resolution", "powers_of_two", "whole_lossy_tiles", "ranks", "no_default_ppi"}, 3: {"has_resolution", "no_zero"}, 4: {"resolution"}}


def test_broken_rules_are_counted_by_the_job_itself(spark):
    rules = [r for r in ex.dicom_rules() if not r.fatal] + ex.resolution_tag_rules()
    counted, seen = ex.observed(_headers(spark), rules, "headers")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("observed", "")
    try:
        assert counted.count() == 4
        before = jobs()
        assert seen.get == {"n_rows": 4, "has_resolution": 1, "resolution": 2, "no_default_ppi": 1, "no_zero": 1}
        assert jobs() == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.warns(UserWarning, match="resolution"):
        assert ex.warn_broken(seen, rules) == {"has_resolution": 1, "resolution": 2, "no_default_ppi": 1, "no_zero": 1}


def test_a_fatal_rule_ends_the_job(spark):
    held, _ = ex.observed(_headers(spark).filter("id <> 2"), ex.tiff_rules(), "fine")
    assert held.count() == 3
    broken, _ = ex.observed(_headers(spark), ex.tiff_rules(), "broken")
    with pytest.raises(Exception, match="multiples of 16"):
        broken.count()


def test_a_doubtful_resolution_is_told():
    with pytest.warns(UserWarning, match="print size"):
        assert not ex.check_resolution((0.5, 25400 / 72))
    with pytest.warns(UserWarning, match="1000 microns"):
        assert not ex.check_resolution(None, required=True)
    assert ex.check_resolution((0.5, 0.25))


def _cells(spark, image):
    rows = [(int(y), int(x), int(c), int(image[y, x, c])) for y, x, c in np.ndindex(image.shape)]
    return spark.createDataFrame(rows, "y bigint, x bigint, c bigint, v bigint").repartition(5)


class Distinct(reducers.Reducer):
    """How many different values a block has: states that do not add up."""

    width = 256

    def update(self, states, block, values):
        states[block, values] = 1

    def merge(self, states, starts):
        return np.maximum.reduceat(states, starts, axis=0)

    def finish(self, states):
        return states.sum(axis=1)


@pytest.mark.parametrize(("reducer", "plain"), [(reducers.Median(), lambda v: sorted(v)[(len(v) - 1) // 2]), (reducers.Spread(), lambda v: max(v) - min(v)), (Distinct(), lambda v: len(set(v)))])
def test_reducers_merge_partial_states(spark, reducer, plain):
    image = np.random.default_rng(8).integers(0, 256, (23, 17, 2), np.uint8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        made = reducers.block_reduce_custom(_cells(spark, image), 5, 4, reducer)
        found = {(r.y, r.x, r.c): r.v for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(y, x, c): plain(image[y * 5 : y * 5 + 5, x * 4 : x * 4 + 4, c].ravel().tolist()) for y in range(5) for x in range(5) for c in range(2)}
    assert reducers.block_reduce_custom(_cells(spark, image).filter("y < 0").drop("c"), 5, 4, reducer).collect() == []


def test_partial_states_come_before_the_shuffle(spark):
    plan = reducers.block_reduce_custom(_cells(spark, np.zeros((4, 4, 1), np.uint8)), 2, 2, reducers.Median())._jdf.queryExecution().executedPlan().toString()
    first, second = plan.index("MapInArrow"), plan.rindex("MapInArrow")
    assert first < plan.index("hashpartitioning(y") < second


class Steps(table_functions.TileWalk):
    """A walk of the caller's own: how far each tile is from the first one of its slide."""

    returns = "slide_id string, far bigint"

    def __init__(self):
        super().__init__()
        self.first = None

    def visit(self, tile):
        self.first = self.first or (tile["ty"], tile["tx"])
        yield tile["slide_id"], abs(tile["ty"] - self.first[0]) + abs(tile["tx"] - self.first[1])


def test_table_functions_serve_sql_text(spark):
    table_functions.register(spark, {"steps": Steps})
    slides = spark.createDataFrame([("a", 5, 3), ("b", 2, 2), ("c", None, 1)], "slide_id string, h int, w int")
    tiles = spark.sql("SELECT s.slide_id, t.* FROM {slides} s, LATERAL tile_cover(s.h, s.w, 2, 2) t", slides=slides)
    assert {tuple(r) for r in tiles.collect()} == {("a", ty, tx, 2 * ty, min(2 * ty + 2, 5), 2 * tx, min(2 * tx + 2, 3)) for ty in range(3) for tx in range(2)} | {("b", 0, 0, 0, 2, 0, 2)}
    shuffled = tiles.filter("NOT (slide_id = 'a' AND ty = 1 AND tx = 0)").orderBy(F.rand(3)).repartition(4)
    walked = spark.sql("SELECT * FROM tile_walk(TABLE({shuffled}))", shuffled=shuffled)
    assert sorted(map(tuple, walked.collect())) == [("a", 0, 0, 0, 0), ("a", 0, 1, 1, 0), ("a", 1, 1, 2, 1), ("a", 2, 0, 3, 0), ("a", 2, 1, 4, 0), ("b", 0, 0, 0, 0)]
    assert sorted(map(tuple, spark.sql("SELECT * FROM steps(TABLE({shuffled}))", shuffled=shuffled).collect())) == [("a", 0), ("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", 0)]
    for bad, said in (("tile_cover(3, 3, 0, 2)", "positive"), ("tile_cover('x', 3, 1, 2)", "whole number"), ("tile_walk(TABLE(SELECT 1 AS ty))", "slide_id")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_a_codec_of_the_callers_own_reaches_the_workers(spark, tmp_path):
    (tmp_path / "flipping.py").write_text("def encode(data, level):\n    return bytes(255 - b for b in data)\n\n\ndef decode(data):\n    return bytes(255 - b for b in data)\n")
    codecs.register(spark, "Flip", "flipping:encode", "flipping:decode", (str(tmp_path / "flipping.py"),))
    slide = Slide("s", 4, 6, 1, 2, 3, "Flip")
    image = np.arange(24, dtype=np.uint8).reshape(4, 6, 1)
    rows = [("s", 0, ty, tx, ty * 2, tx * 3, 2, 3, 1, bytearray(image[ty * 2 : ty * 2 + 2, tx * 3 : tx * 3 + 3].tobytes())) for ty in range(2) for tx in range(2)]
    tiles = spark.createDataFrame(rows, chunks.TILES).repartition(3).drop("level")
    slide.tiles = encode_tiles(tiles, slide)
    assert {bytes(r.payload) for r in slide.tiles.collect()} == {bytes(255 - b for b in bytes(r[9])) for r in rows}
    assert codecs.can_decode("Flip") and not codecs.can_decode("Flop")
    out = {(r.y0, r.x0): bytes(r.payload) for r in decode_tiles(slide).collect()}
    assert out == {(r[4], r[5]): bytes(r[9]) for r in rows}
    codecs.register(spark, "Lost", "nowhere:encode", None)
    slide.codec = "Lost"
    with pytest.raises(Exception, match="codec Lost: nowhere:encode is not to be found"):
        encode_tiles(tiles, slide).collect()
    with pytest.raises(ValueError, match="module:function"):
        codecs.register(spark, "Bad", "nowhere", None)
    # the library's own names stay what they are
    codecs.register(spark, "Zlib", "nowhere:encode", "nowhere:decode")
    assert codecs.decode("Zlib", codecs.encode("Zlib", b"abc")) == b"abc"
