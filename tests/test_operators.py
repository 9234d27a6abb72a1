from __future__ import annotations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.functions import grid, magic, ngff, svs, units, vocab
from mosaiq.operators import cells as cell_ops
from mosaiq.operators import order, pyramid, reduce, regrid, resample, running
from mosaiq.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(str([_plain(r[c]) for c in columns]) for r in got.collect())
    found = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert rows == sorted(str([_plain(r[k]) for k in at]) for r in found.fetchall())


shapes = st.tuples(st.integers(1, 60), st.integers(1, 60), st.integers(1, 20), st.integers(1, 20))


@given(shapes)
def test_tiles_cover_without_overlap(s):
    h, w, th, tw = s
    seen = np.zeros((h, w), int)
    for ty in range(grid.mosaic_shape((h, w), (th, tw))[0]):
        for tx in range(grid.mosaic_shape((h, w), (th, tw))[1]):
            seen[grid.tile_slices((ty, tx), (th, tw))] += 1
    assert (seen == 1).all()


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=4), st.booleans())
def test_wrapping_keeps_the_flat_index(pairs, last):
    index, shape = [p[0] for p in pairs], [p[1] for p in pairs]
    wrapped, over = grid.wrap_index(index, shape, last)
    order_ = list(range(len(shape)))[::-1] if last else list(range(len(shape)))
    flat = lambda ix, extra: sum(i * int(np.prod([shape[a] for a in order_[:k]] or [1])) for k, i in enumerate(ix[a] for a in order_)) + extra * int(np.prod(shape))
    assert flat(index, 0) == flat(wrapped, over) and all(0 <= i < s for i, s in zip(wrapped, shape, strict=True))


def test_grid_examples():
    assert grid.mosaic_shape((13, 13), (8, 8)) == (2, 2)
    assert grid.block_downsample_shape((135, 145), 3, (32, 32)) == ((42, 45), (10, 10))
    assert grid.wrap_index((0, 3), (3, 3)) == ((1, 0), 0)
    assert grid.wrap_index((3, 1), (3, 3), last_is_least=False) == ((0, 2), 0)
    assert grid.strictly_increasing([]) and not grid.strictly_increasing([1, 1])
    assert grid.thumbnail_downsample((10, 10), (5, 5), (100, 100)) == 1
    with pytest.raises(ValueError, match="ranks"):
        grid.wrap_index((1,), (2, 2))
    with pytest.raises(ValueError, match="axis"):
        grid.downsample_shape((4, 4), (2,))


def test_units_round_trip():
    for unit in units.MICRONS:
        assert np.isclose(units.to_mpp(units.to_ppu(0.25, unit), unit), 0.25)
    assert units.to_mpp(0, "um") == 0
    assert units.check_mpp(0.5) and not units.check_mpp(1000.0) and not units.check_mpp(25400 / 72) and not units.check_mpp(6.0) and not units.check_mpp(None)


@pytest.mark.parametrize("name", vocab.CODECS)
def test_each_codec_by_name(name):
    assert vocab.codec(vocab.condensed(name).lower()) == name
    if name == "LZ77":
        with pytest.raises(ValueError, match="chunks"):
            vocab.chunk_codec(name)
    else:
        made = vocab.chunk_codec(name, level=3)
        key = "clevel" if name in vocab.CLEVEL_CODECS else "level"
        assert (made.get(key) == 3) == (name not in vocab.LEVELLESS_CODECS)


def test_vocabulary_codes():
    assert vocab.codec("ISO_14495_1") == "JPEG-LS" and vocab.color("sRGB") == "RGB" and vocab.color("CIE L*a*b*") == "CIE L*a*b*"
    assert vocab.transfer_syntax("JPEG").endswith(".50") and vocab.transfer_syntax("JPEG 2000", False).endswith(".91")
    assert vocab.photometric("YCbCr") == "YBR_FULL_422" and vocab.photometric("YCbCr", (4, 4, 4)) == "YBR_FULL" and vocab.jp2_color("Grey") == 17
    for f, bad in ((vocab.codec, "x"), (vocab.color, "x"), (vocab.jp2_color, "HSV"), (vocab.photometric, "HSV"), (vocab.transfer_syntax, "GIF")):
        with pytest.raises(ValueError):
            f(bad)


def test_each_signature_and_a_near_miss(spark):
    rows, want = [], []
    for kind, rule in magic.RULES.items():
        sign = rule[0][0]
        good = (b"\0" * (sign.at or 0)) + (sign.bytes_ or (b"RIFF\n\n\n\nWEBP" if kind == ("webp",) else b"<DESCRIPTION>\n Omnyx"))
        if len(kind) == 2:
            good = {"tiff": b"II\x2a\x00", "jp2": b"\x00\x00\x00\x0cjP  \r\n\x87\n"}[kind[0]] + b"pad" + good
        for content in (good, b"?" + good, good[:-1], b"\0" * 2000 + good):
            rows.append((len(rows), bytearray(content)))
            want.append([list(t) for t in magic.types_of(content[: magic.HEADER_BYTES])])
        assert list(kind) in want[-4] and list(kind) not in want[-2]
    got = spark.createDataFrame(rows, "id int, content binary").select("id", magic.file_types(F.col("content")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == want


def test_descriptions_parse_back(spark):
    twice = spark.range(1).select(svs.parse_description(F.lit("head\nA = 1|B = 2|A = 3|none")).alias("m")).first().m
    assert twice == {"A": "3", "B": "2"}
    one = spark.range(1).select(svs.parse_description(svs.build_description(F.lit("head\nline"), {"MPP": F.lit(0.5), "None": F.lit(None).cast("int"), "App Mag": F.lit(20)})).alias("m")).first().m
    assert one == {"MPP": "0.5", "App Mag": "20"}


def test_metadata_parses_back_and_drops_nulls(spark):
    frame = spark.createDataFrame([(0.5,), (None,)], "mpp double")
    got = frame.select(ngff.zattrs_json([(0, 1), (1, 4)], F.col("mpp"), F.col("mpp")).alias("j")).select("j", ngff.parse_zattrs(F.col("j")).alias("z")).collect()
    steps = [r.z.multiscales[0].datasets[1].coordinateTransformations[0] for r in got]
    assert steps[0].scale == [2.0, 2.0, 1.0] and steps[0].type == "scale" and steps[1].type == "identity"
    assert '"scale":' not in got[1].j and len(ngff.SPACE_UNITS) == 26 and len(ngff.TIME_UNITS) == 23


def _image(h, w, c, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def _cells(spark, image):
    rows = [("s", y, x, k, int(image[y, x, k])) for y, x, k in np.ndindex(image.shape)]
    return spark.createDataFrame(rows, "slide_id string, y bigint, x bigint, c bigint, v bigint")


def _back(df, h, w, c):
    out = np.zeros((h, w, c), np.uint8)
    for r in df.collect():
        out[r.y, r.x, r.c] = r.v
    return out


def test_tiles_and_cells_agree(spark):
    image = _image(23, 17, 3)
    tiles = cell_ops.cells_to_tiles(_cells(spark, image), 7, 5, 23, 17, 3)
    assert tiles.count() == 4 * 4
    assert (_back(cell_ops.tiles_to_cells(tiles), 23, 17, 3) == image).all()
    again = regrid.regrid_tiles(regrid.regrid_tiles(tiles, 4, 9, 23, 17), 7, 5, 23, 17)
    key = lambda df: sorted((r.ty, r.tx, bytes(r.payload)) for r in df.collect())
    assert key(again) == key(tiles)
    pooled = cell_ops.tiles_to_cells(cell_ops.pool_tiles(tiles, 3, 7, 5))
    by_cells = reduce.mean_pool_tiled(_cells(spark, image), 3, 7, 5, 23, 17)
    rows = lambda df: sorted((r.y, r.x, r.c, r.v) for r in df.collect())
    assert rows(pooled) == rows(by_cells)


def test_pyramids_agree_on_constants_and_check_factors(spark):
    cells = spark.range(12 * 10).select((F.col("id") % 12).alias("y"), F.floor(F.col("id") / 12).alias("x"), F.lit(7).cast("bigint").alias("v"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pyramid.cascade(cells, [2, 4], 12, 10)) == rows(pyramid.direct(cells, [2, 4], 12, 10))
    for bad in ([2, 3], [4, 2], [1]):
        with pytest.raises(ValueError, match="multiples"):
            pyramid.cascade(cells, bad, 12, 10)


def test_blanks_and_regions(spark):
    tiles = spark.createDataFrame([(0, 0, 5), (1, 1, 6)], "ty bigint, tx bigint, v bigint")
    assert sorted((r.ty, r.tx) for r in cell_ops.blank_tiles(tiles, 4, 4, 2, 2).collect()) == [(0, 1), (1, 0)]
    assert sorted(r.v for r in cell_ops.fill_blanks(tiles, "v", 4, 4, 2, 2).collect()) == [0, 0, 5, 6]
    cells = _cells(spark, _image(6, 5, 1))
    assert cell_ops.region(cells, slice(4, 99), slice(None, 2), 6, 5).count() == 4


def _plain_resize(image, to_h, to_w, kernel):
    """Separable weights by their definition, normalised; whole numbers where they are exact."""
    from fractions import Fraction

    def weight(at, o, n, m):
        if kernel == "area":
            return max(Fraction(0), min(Fraction(o + 1) * n / m, at + 1) - max(Fraction(o) * n / m, at))
        t = abs(at - (Fraction(2 * o + 1, 2) * n / m - Fraction(1, 2))) / max(Fraction(1), Fraction(n, m))
        if kernel in ("box", "bilinear"):
            return Fraction(t <= Fraction(1, 2)) if kernel == "box" else max(Fraction(0), 1 - t)
        t = float(t)
        if kernel == "bicubic":
            return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0
        return float(np.sinc(t) * np.sinc(t / 3)) if t < 3 else 0

    def axis(n, m):
        made = [[weight(at, o, n, m) for at in range(n)] for o in range(m)]
        return [[w / sum(row) for w in row] for row in made]

    rows, cols = axis(image.shape[0], to_h), axis(image.shape[1], to_w)
    out = [[sum(int(image[y, x]) * rows[i][y] * cols[j][x] for y in range(image.shape[0]) for x in range(image.shape[1]) if rows[i][y] and cols[j][x]) for j in range(to_w)] for i in range(to_h)]
    return out


@pytest.mark.parametrize("kernel", ["area", "box", "bilinear", "bicubic", "lanczos"])
@pytest.mark.parametrize("shape", [(9, 7, 4, 3), (5, 6, 11, 4), (1, 8, 3, 8)])
def test_resizing_is_the_weighted_sum(spark, monkeypatch, kernel, shape):
    h, w, to_h, to_w = shape
    image = np.random.default_rng(h).integers(0, 256, (h, w), np.uint8)
    if h == 5:
        monkeypatch.setattr(resample, "BROADCAST_WEIGHTS", 0)
    cells = spark.createDataFrame([(y, x, c, int(image[y, x]) if c else 9) for y in range(h) for x in range(w) for c in (0, 1)], "y bigint, x bigint, c bigint, v bigint")
    found = {(r.y, r.x, r.c): r.v for r in resample.resize(cells, h, w, to_h, to_w, kernel).collect()}
    assert len(found) == 2 * to_h * to_w and all(v == 9 for (_, _, c), v in found.items() if not c)
    plain = _plain_resize(image, to_h, to_w, kernel)
    for i in range(to_h):
        for j in range(to_w):
            exact = min(255, max(0, int(np.floor(plain[i][j] + (0.5 if isinstance(plain[i][j], float) else 1 / type(plain[i][j])(2))))))
            # doubles may fall on either side of a half
            assert abs(found[i, j, 1] - exact) <= (kernel in ("bicubic", "lanczos") and abs(plain[i][j] % 1 - 0.5) < 1e-9)


def test_resizing_checks_names_and_sums_before_it_shuffles(spark):
    cells = _cells(spark, _image(8, 6, 1))
    with pytest.raises(KeyError):
        resample.resize(cells, 8, 6, 2, 2, "sharp")
    with pytest.raises(ValueError, match="resize"):
        resample.resize(cells, 8, 6, 0, 2)
    plan = resample.resize(cells, 8, 6, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum(") >= 2 and "SortMergeJoin" not in plan and "Python" not in plan and "Arrow" not in plan


def _packed(spark, image, th, tw, keep=lambda ty, tx: True):
    h, w = image.shape[:2]
    rows = []
    for ty in range(-(-h // th)):
        for tx in range(-(-w // tw)):
            part = image[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw]
            if keep(ty, tx):
                rows.append(("s", ty, tx, ty * th, tx * tw, *part.shape, bytearray(part.tobytes())))
    return spark.createDataFrame(rows, cell_ops.TILE).repartition(3)


def _unpacked(tiles, h, w, c):
    out, seen = np.zeros((h, w, c), np.uint8), np.zeros((h, w), int)
    for t in tiles.collect():
        out[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.frombuffer(bytes(t.payload), np.uint8).reshape(t.h, t.w, t.c)
        seen[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] += 1
    return out, seen


@pytest.mark.parametrize(("th", "tw", "to_h", "to_w"), [(8, 5, 9, 11), (4, 4, 40, 50), (30, 30, 7, 7), (1, 3, 1, 5), (5, 8, 29, 1), (3, 1, 29, 31)])
def test_a_spline_zoom_is_linear_between_corners(spark, th, tw, to_h, to_w):
    h, w = 29, 31
    image = np.random.default_rng(6).integers(0, 256, (h, w, 2), np.uint8)
    found, seen = _unpacked(resample.spline_zoom(_packed(spark, image, th, tw), h, w, to_h, to_w), to_h, to_w, 2)
    assert (seen == 1).all()
    at = lambda n, m: [divmod(o * (n - 1 if m > 1 else 0), max(1, m - 1)) for o in range(m)]
    for i, (a, r) in enumerate(at(h, to_h)):
        for j, (p, s) in enumerate(at(w, to_w)):
            d, e = max(1, to_h - 1), max(1, to_w - 1)
            v = image.astype(int)
            b, q = min(a + 1, h - 1), min(p + 1, w - 1)
            both = (v[a, p] * (d - r) + v[b, p] * r) * (e - s) + (v[a, q] * (d - r) + v[b, q] * r) * s
            assert (found[i, j] == (2 * both + d * e) // (2 * d * e)).all(), (i, j)


def test_splines_of_cells_and_of_tiles_agree(spark):
    image = np.random.default_rng(9).integers(0, 256, (13, 11, 1), np.uint8)
    cells = _cells(spark, image)
    for to_h, to_w in ((5, 20), (13, 1), (1, 4)):
        found, _ = _unpacked(resample.spline_zoom(_packed(spark, image, 4, 3), 13, 11, to_h, to_w), to_h, to_w, 1)
        assert {(r.y, r.x): r.v for r in resample.resize(cells, 13, 11, to_h, to_w, "spline").collect()} == {(y, x): found[y, x, 0] for y in range(to_h) for x in range(to_w)}


def test_methods_of_downsampling_and_shapes_of_thumbnails(spark):
    image = _image(9, 8, 1)
    cells = _cells(spark, image)
    with pytest.raises(ValueError, match="unknown method"):
        resample.downsample(cells, 9, 8, 2, "sharp")
    sides = {m: {(r.y, r.x) for r in resample.downsample(cells, 9, 8, 2, m).collect()} for m in resample.METHODS}
    assert all(len(sides[m]) == 4 * 4 for m in resample.METHODS)  # 9 / 2 is rounded to even
    assert resample.thumbnail_shape(500, 64, 100, 16) == (100, 12) and resample.thumbnail_shape(64, 500, 100, 16) == (2, 16) and resample.thumbnail_shape(10, 10, 30, 20) == (20, 20)
    assert resample.svs_thumbnail_shape(50_000, 30_000, 16, 16) == (3125, 1875) and resample.svs_thumbnail_shape(4096, 2048, 256, 256) == (1024, 512)
    fit = {(r.y, r.x): r.v for r in resample.thumbnail_fit(cells, 9, 8, 3, 3).collect()}
    assert {k for k in fit} == {(y, x) for y in range(3) for x in range(2)}


def test_a_thumbnail_whose_side_rounds_to_nothing_has_no_cells(spark):
    cells = _cells(spark, _image(60, 2, 1))
    assert resample.thumbnail_fit(cells, 60, 2, 29, 9).count() == 0  # 2 * 29 // 60
    assert resample.thumbnail_fit(cells, 60, 2, 30, 9).count() == 30
    assert resample.thumbnail_fit(_cells(spark, _image(2, 60, 1)), 2, 60, 9, 29).count() == 0


@pytest.mark.parametrize("cascade", [True, False])
@pytest.mark.parametrize(("factors", "missing"), [([2, 4, 8], False), ([3, 6], False), ([2, 4], True)])
def test_a_tile_pyramid_equals_pooling(spark, monkeypatch, cascade, factors, missing):
    from mosaiq.operators import tile_pyramid

    th, tw = (24, 48) if factors[0] == 2 else (12, 18)
    h, w = 24 * 5 + 7, 48 * 3 + 5
    image = np.random.default_rng(7).integers(0, 256, (h, w, 3), np.uint8)
    keep = (lambda ty, tx: (ty + tx) % 2 == 0) if missing else (lambda ty, tx: True)
    if missing:
        monkeypatch.setattr(tile_pyramid, "OPEN", 2)
        for ty in range(-(-h // th)):
            for tx in range(-(-w // tw)):
                if not keep(ty, tx):
                    image[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw] = 0
    made = tile_pyramid.tile_pyramid(_packed(spark, image, th, tw, keep), factors, th, tw, h, w, cascade)
    pool = lambda a, f: (a[: a.shape[0] // f * f, : a.shape[1] // f * f].reshape(a.shape[0] // f, f, a.shape[1] // f, f, 3).astype(int).sum(axis=(1, 3)) // (f * f)).astype(np.uint8)
    below, before = image, 1
    for k, f in enumerate(factors, 1):
        below = pool(below, f // before) if cascade else pool(image, f)
        below, before = below[: h // f, : w // f], f
        level = made.filter(F.col("level") == k)
        found, seen = _unpacked(level, h // f, w // f, 3)
        assert (found == below).all() and (missing or (seen == 1).all())
        assert {(r.h, r.w) for r in level.collect()} <= {(min(th, h // f - y), min(tw, w // f - x)) for y in range(0, h // f, th) for x in range(0, w // f, tw)}


def test_a_tile_pyramid_shuffles_parts_of_cut_parents_only(spark):
    from mosaiq.operators import tile_pyramid

    image = np.zeros((16 * 16, 16 * 16, 1), np.uint8)
    tiles = _packed(spark, image, 16, 16)
    for bad, said in (([4, 2], "growing"), ([2, 3], "growing"), ([2, 4, 8, 16, 32], "no multiples")):
        with pytest.raises(ValueError, match=said):
            tile_pyramid.tile_pyramid(tiles, bad, 16, 16, 256, 256)
    made = tile_pyramid.tile_pyramid(tiles, [2, 4, 8], 16, 16, 256, 256)
    stored = spark.read.parquet(made.inputFiles()[0].rsplit("/", 1)[0])
    assert made.count() == 64 + 16 + 4
    # 4 ranges of 256 tiles: all but the parents at their edges are whole where they were made
    assert stored.filter("NOT whole").count() < 0.2 * (3 * 256)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("chunk", [3, 7, 1 << 16])
def test_running_sums_cross_chunks(spark, chunk):
    frame = spark.range(20).select(((F.col("id") * 7) % 20).alias("k"), (F.col("id") * 3 % 11).alias("v"))
    rows = sorted(running.running_max(running.running_sum(frame, "k", F.col("v"), "s", chunk), "k", F.col("v"), "m", chunk).collect())
    total, top = 0, 0
    for r in rows:
        top = max(top, r.v)
        assert (r.s, r.m) == (total, top)
        total += r.v


def test_a_tile_is_ready_when_all_it_needs_has_come(spark):
    read = grid.grid(spark, 4, 4, 2, 2)
    come = order.row_major(read, 2).withColumn("arrival", F.when(F.col("idx") != 3, F.col("idx") * 10))
    ready = {(r.oy, r.ox): r.ready for r in regrid.ready_times(come, 3, 3).collect()}
    assert ready == {(0, 0): None, (0, 1): None, (1, 0): None, (1, 1): None}
    ready = {(r.oy, r.ox): r.ready for r in regrid.ready_times(come, 2, 4).collect()}
    assert ready == {(0, 0): 10, (1, 0): None}
