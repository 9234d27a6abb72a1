"""The query catalogue: each entry is one operator on derived data, with its SQL beside it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import expectations, grid, magic, svs, units, vocab
from mosaiq.operators import cells as cell_ops
from mosaiq.operators import frames as frame_ops
from mosaiq.operators import coverage, order, pyramid, reduce, reducers, regrid, resample, table_functions, tile_pyramid
from mosaiq.plans import fixtures as fx
from mosaiq.sources import chunks, files
from mosaiq.streaming import reorder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TILE_H, TILE_W, WIDTH = fx.TILE_H, fx.TILE_W, fx.WIDTH

# common table expressions of the oracle queries
E = """e AS (SELECT vec_id AS y, CAST(i AS BIGINT) AS x,
             CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS v
             FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)),
       size AS (SELECT count(*) AS h, CAST(64 AS BIGINT) AS w FROM embeddings)"""
L = """g AS (SELECT l_suppkey AS y, l_partkey AS x, CAST(sum(l_quantity) AS BIGINT) AS a, CAST(sum(l_linenumber) AS BIGINT) AS b, count(*) AS n
             FROM lineitem GROUP BY ALL),
       l AS (SELECT y, x, CAST(0 AS BIGINT) AS c, a % 256 AS v FROM g UNION ALL SELECT y, x, 1, b % 256 FROM g UNION ALL SELECT y, x, 2, n % 256 FROM g),
       size AS (SELECT (SELECT count(*) FROM supplier) AS h, (SELECT count(*) FROM part) AS w)"""
GRID_E = f"""{E}, grid AS (SELECT ty, tx, ty * {TILE_H} AS y0, least((ty + 1) * {TILE_H}, h) AS y1, tx * {TILE_W} AS x0, least((tx + 1) * {TILE_W}, w) AS x1
             FROM (SELECT h, w, unnest(range(0, CAST(ceil(h / {TILE_H}) AS BIGINT))) AS ty FROM size), (SELECT unnest(range(0, CAST(ceil(64 / {TILE_W}) AS BIGINT))) AS tx))"""
YIELD_H, YIELD_W = 32, 20
YIELD = f"""yields AS (SELECT oy, ox, oy * {YIELD_H} AS p0, least((oy + 1) * {YIELD_H}, h) AS p1, ox * {YIELD_W} AS q0, least((ox + 1) * {YIELD_W}, w) AS q1
             FROM (SELECT h, w, unnest(range(0, CAST(ceil(h / {YIELD_H}) AS BIGINT))) AS oy FROM size), (SELECT unnest(range(0, CAST(ceil(64 / {YIELD_W}) AS BIGINT))) AS ox))"""
BYTE_MEAN = "CAST(floor(least(255, greatest(0, avg(v)))) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _grid_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid(spark, fx.height_e(spark, sf_dir), WIDTH, TILE_H, TILE_W)


# reductions


@query(f"WITH {E} SELECT y // 4 AS y, x // 4 AS x, {BYTE_MEAN} AS v FROM e GROUP BY ALL")
def pool_mean_4(spark, sf_dir):
    return reduce.mean_pool(fx.raster_e(spark, sf_dir), 4)


@query(f"WITH {E} SELECT y // 5 AS y, x // 3 AS x, min(v) AS least_v, max(v) AS most_v, CAST(sum(v) AS BIGINT) AS sum_v FROM e GROUP BY ALL")
def block_reduce(spark, sf_dir):
    return reduce.block_reduce(fx.raster_e(spark, sf_dir), 5, 3, [F.min("v").alias("least_v"), F.max("v").alias("most_v"), F.sum("v").alias("sum_v")])


@query(f"WITH {E} SELECT y // 5 AS y, x // 5 AS x, {BYTE_MEAN} AS v FROM e, size WHERE y < h // 5 * 5 AND x < w // 5 * 5 GROUP BY ALL")
def pool_trim(spark, sf_dir):
    return reduce.mean_pool(fx.raster_e(spark, sf_dir), 5, fx.height_e(spark, sf_dir), WIDTH)


@query(f"""WITH {E} SELECT y // {TILE_H} * ({TILE_H} // 5) + y % {TILE_H} // 5 AS y, x // {TILE_W} * ({TILE_W} // 5) + x % {TILE_W} // 5 AS x, {BYTE_MEAN} AS v
           FROM e, size WHERE y % {TILE_H} < least({TILE_H}, h - y // {TILE_H} * {TILE_H}) // 5 * 5 AND x % {TILE_W} < least({TILE_W}, w - x // {TILE_W} * {TILE_W}) // 5 * 5 GROUP BY ALL""")
def thumbnail_tiled(spark, sf_dir):
    return reduce.mean_pool_tiled(fx.raster_e(spark, sf_dir), 5, TILE_H, TILE_W, fx.height_e(spark, sf_dir), WIDTH)


@query(f"WITH {L} SELECT y // 4 AS y, x // 4 AS x, c, {BYTE_MEAN} AS v FROM l, size WHERE y < h // 4 * 4 AND x < w // 4 * 4 GROUP BY ALL")
def pool_channels(spark, sf_dir):
    h, w = fx.extent_l(spark, sf_dir)
    return reduce.mean_pool(fx.raster_l(spark, sf_dir, 4, 4), 4, h, w)


CASCADE = f"""{E}, a AS (SELECT y // 2 AS y, x // 2 AS x, {BYTE_MEAN} AS v FROM e, size WHERE y < h // 2 * 2 AND x < w // 2 * 2 GROUP BY ALL),
    b AS (SELECT y // 2 AS y, x // 2 AS x, {BYTE_MEAN} AS v FROM a, size WHERE y < h // 2 // 2 * 2 AND x < w // 2 // 2 * 2 GROUP BY ALL)"""
DIRECT = f"""{E}, p AS (SELECT y // 2 AS y, x // 2 AS x, {BYTE_MEAN} AS v FROM e, size WHERE y < h // 2 * 2 AND x < w // 2 * 2 GROUP BY ALL),
    q AS (SELECT y // 4 AS y, x // 4 AS x, {BYTE_MEAN} AS v FROM e, size WHERE y < h // 4 * 4 AND x < w // 4 * 4 GROUP BY ALL)"""


@query(f"WITH {CASCADE} SELECT CAST(2 AS BIGINT) AS downsample, y, x, v FROM a UNION ALL SELECT 4, y, x, v FROM b")
def pyramid_cascade(spark, sf_dir):
    return pyramid.cascade(fx.raster_e(spark, sf_dir), [2, 4], fx.height_e(spark, sf_dir), WIDTH)


@query(f"WITH {DIRECT} SELECT CAST(2 AS BIGINT) AS downsample, y, x, v FROM p UNION ALL SELECT 4, y, x, v FROM q")
def pyramid_direct(spark, sf_dir):
    return pyramid.direct(fx.raster_e(spark, sf_dir), [2, 4], fx.height_e(spark, sf_dir), WIDTH)


@query(f"WITH {CASCADE} SELECT CAST(2 AS BIGINT) AS downsample, y, x, v FROM a UNION ALL SELECT 4, y, x, v FROM b")
def pyramid_tiles(spark, sf_dir):
    levels = tile_pyramid.tile_pyramid(_tiles_e(spark, sf_dir).drop("level"), [2, 4], TILE_H, TILE_W, fx.height_e(spark, sf_dir), WIDTH)
    # a level is a raster of its own; its downsample names it
    return cell_ops.tiles_to_cells(levels.withColumn("slide_id", F.col("downsample").cast("string"))).select(F.col("slide_id").cast("bigint").alias("downsample"), "y", "x", "v")


@query(f"""WITH {CASCADE}, {DIRECT.removeprefix(E + ",")}
    SELECT CAST(2 AS BIGINT) AS downsample, count(*) AS n_cells, CAST(count_if(a.v <> p.v) AS BIGINT) AS n_differ FROM a JOIN p USING (y, x)
    UNION ALL SELECT 4, count(*), CAST(count_if(b.v <> q.v) AS BIGINT) FROM b JOIN q USING (y, x)""")
def pyramid_drift(spark, sf_dir):
    return pyramid.drift(fx.raster_e(spark, sf_dir), [2, 4], fx.height_e(spark, sf_dir), WIDTH)


@query("SELECT CAST(level AS INTEGER) AS level, d AS downsample, d // coalesce(lag(d) OVER (ORDER BY level), 1) AS factor FROM (VALUES (0, CAST(1 AS BIGINT)), (1, 2), (2, 4), (3, 16), (4, 32)) t(level, d)")
def level_factors(spark, sf_dir):
    return pyramid.level_factors(spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 16), (4, 32)], "level int, downsample bigint"))


# grid arithmetic


@query(f"WITH {E} SELECT CAST(ceil(h / {TILE_H}) AS BIGINT) AS tiles_y, CAST(ceil(w / {TILE_W}) AS BIGINT) AS tiles_x, CAST(ceil(h / {TILE_H}) * ceil(w / {TILE_W}) AS BIGINT) AS n_tiles FROM size")
def mosaic_shape(spark, sf_dir):
    shape = fx.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("h"))
    y, x = grid.tiles_across(F.col("h"), TILE_H), grid.tiles_across(WIDTH, TILE_W)
    return shape.select(y.alias("tiles_y"), x.alias("tiles_x"), (y * x).alias("n_tiles"))


@query(f"WITH {GRID_E} SELECT * FROM grid")
def tile_bounds(spark, sf_dir):
    return _grid_e(spark, sf_dir)


SHAPES = "FROM size, (SELECT unnest(range(1, 9)) AS d)"


@query(f"WITH {E} SELECT d, CAST(floor(h / d) AS BIGINT) AS floor_h, CAST(floor(w / d) AS BIGINT) AS floor_w, CAST(ceil(h / d) AS BIGINT) AS ceil_h {SHAPES}")
def downsample_shape(spark, sf_dir):
    h, d = fx.height_e(spark, sf_dir), F.col("id")
    return spark.range(1, 9).select(d.alias("d"), grid.downsampled(h, d).alias("floor_h"), grid.downsampled(WIDTH, d).alias("floor_w"), grid.downsampled(h, d, F.ceil).alias("ceil_h"))


@query(f"""WITH {E}, d AS (SELECT unnest(range(1, 9)) AS d),
    c AS (SELECT d, y // {TILE_H} * ({TILE_H} // d) + y % {TILE_H} // d AS oy, x // {TILE_W} * ({TILE_W} // d) + x % {TILE_W} // d AS ox FROM e, size, d
          WHERE y % {TILE_H} < least({TILE_H}, h - y // {TILE_H} * {TILE_H}) // d * d AND x % {TILE_W} < least({TILE_W}, w - x // {TILE_W} * {TILE_W}) // d * d)
    SELECT d, count(DISTINCT oy) AS h, count(DISTINCT ox) AS w FROM c GROUP BY d""")
def block_downsample_shape(spark, sf_dir):
    h, d = fx.height_e(spark, sf_dir), F.col("id")
    return spark.range(1, 9).select(d.alias("d"), grid.block_downsampled(h, d, TILE_H).alias("h"), grid.block_downsampled(WIDTH, d, TILE_W).alias("w"))


@query("SELECT p_partkey AS id, least(100.0::DOUBLE / CAST(p_size AS DOUBLE), 60.0::DOUBLE / CAST(p_size + 7 AS DOUBLE)) AS scale FROM part")
def scale_to_fit(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), grid.fit_scale(F.col("p_size"), F.col("p_size") + 7, F.lit(100.0), F.lit(60.0)).alias("scale"))


@query("SELECT event_id AS id, (event_id % 31 + event_id // 17) % 13 AS y, event_id % 17 AS x, (event_id % 31 + event_id // 17) // 13 AS overflow FROM events")
def wrap_index(spark, sf_dir):
    y, x, over = grid.wrap(F.col("event_id") % 31, F.col("event_id"), 13, 17)
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), y.alias("y"), x.alias("x"), over.alias("overflow"))


@query("""SELECT user_id, coalesce(bool_and(event_id > before), TRUE) AS by_time, coalesce(bool_and(v > before_v), TRUE) AS by_value
    FROM (SELECT user_id, event_id, value AS v, lag(event_id) OVER w AS before, lag(value) OVER w AS before_v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id""")
def strictly_increasing(spark, sf_dir):
    listed = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("es"))
    return listed.select("user_id", grid.increasing(F.col("es.event_id")).alias("by_time"), grid.increasing(F.col("es.value")).alias("by_value"))


@query(f"WITH {GRID_E} SELECT ty, tx, row_number() OVER (ORDER BY ty, tx) - 1 AS idx FROM grid")
def row_major_index(spark, sf_dir):
    return order.row_major(_grid_e(spark, sf_dir), -(-WIDTH // TILE_W)).select("ty", "tx", "idx")


@query(f"""WITH {E}, d AS (SELECT unnest(range(1, 65)) AS d)
    SELECT min(d) AS downsample FROM size, d WHERE h // {TILE_H} * ({TILE_H} // d) + h % {TILE_H} // d <= 100 AND w // {TILE_W} * ({TILE_W} // d) + w % {TILE_W} // d <= 16""")
def thumbnail_downsample(spark, sf_dir):
    h, d = fx.height_e(spark, sf_dir), F.col("id")
    fits = (grid.block_downsampled(h, d, TILE_H) <= 100) & (grid.block_downsampled(WIDTH, d, TILE_W) <= 16)
    return spark.range(1, 65).filter(fits).agg(F.min("id").alias("downsample"))


# units

R = "r AS (SELECT p_partkey AS id, p_size / 20.0::DOUBLE AS mpp, ['um', 'mm', 'cm', 'inch', '2', '3'][CAST(p_partkey % 6 AS INTEGER) + 1] AS unit FROM part), k AS (SELECT * FROM (VALUES ('um', 1.0::DOUBLE), ('mm', 1e3), ('cm', 1e4), ('inch', 25400.0), ('2', 25400.0), ('3', 1e4)) t(unit, k))"


@query(f"WITH {R} SELECT id, unit, (1.0::DOUBLE / mpp) * k AS ppu FROM r JOIN k USING (unit)")
def mpp_to_ppu(spark, sf_dir):
    return fx.resolutions(spark, sf_dir).select("id", "unit", units.mpp_to_ppu(F.col("mpp"), F.col("unit")).alias("ppu"))


@query(f"WITH {R} SELECT id, unit, CASE WHEN floor(mpp) = 0 THEN 0 ELSE (1.0::DOUBLE / floor(mpp)) * k END AS mpp FROM r JOIN k USING (unit)")
def ppu_to_mpp(spark, sf_dir):
    ppu = F.floor("mpp").cast("double")
    return fx.resolutions(spark, sf_dir).select("id", "unit", units.ppu_to_mpp(ppu, F.col("unit")).alias("mpp"))


@query(f"""WITH {R}, m AS (SELECT id, CASE id % 8 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 25400.0::DOUBLE / 72 WHEN 2 THEN 25400.0::DOUBLE / 300 WHEN 3 THEN 25400.0::DOUBLE / 600 ELSE mpp * 4 END AS mpp FROM r)
    SELECT id, NOT ((1.0::DOUBLE / mpp) * 1e3 = 1 OR (1.0::DOUBLE / mpp) * 1e4 = 1 OR (1.0::DOUBLE / mpp) * 25400.0 IN (1, 72, 150, 300, 1200, 2400) OR mpp > 5) AS ok FROM m""")
def check_mpp(spark, sf_dir):
    kind = F.col("id") % 8
    mpp = F.when(kind == 0, 1000.0).when(kind == 1, F.lit(25400.0) / 72).when(kind == 2, F.lit(25400.0) / 300).when(kind == 3, F.lit(25400.0) / 600).otherwise(F.col("mpp") * 4)
    return fx.resolutions(spark, sf_dir).select("id", units.plausible_mpp(mpp).alias("ok"))


@query(f"""WITH {R}, m AS (SELECT unnest([{", ".join(map(str, units.MAGNIFICATIONS))}])::DOUBLE AS mag),
    n AS (SELECT id, mag, row_number() OVER (PARTITION BY id ORDER BY abs(mag - 10.0::DOUBLE / mpp), mag) AS k FROM r, m) SELECT id, mag FROM n WHERE k = 1""")
def nearest_app_mag(spark, sf_dir):
    return fx.resolutions(spark, sf_dir).select("id", units.nearest_magnification(F.col("mpp")).alias("mag"))


# vocabularies

CODES = sorted(vocab.TIFF_CODECS)


@query(f"""SELECT o_orderkey AS id, codec FROM (SELECT o_orderkey, [{", ".join(map(str, CODES))}, 4][CAST(o_orderkey % {len(CODES) + 1} AS INTEGER) + 1] AS code FROM orders)
    LEFT JOIN (VALUES {", ".join(f"({k}, '{v}')" for k, v in vocab.TIFF_CODECS.items())}) t(code, codec) USING (code)""")
def codec_from_tiff(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in [*CODES, 4]]), (F.col("o_orderkey") % (len(CODES) + 1) + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), vocab.codec_of_tiff(code).alias("codec"))


# Spellings that the queries look up.
SPELLINGS = ("jpeg", "JPEG 2000", "jpeg-xl", "Jpeg Ls", "ISO_10918_1", "iso_15444_1", "PackBits", "web p", "zstd", "nonsense", "none")
COLOR_SPELLINGS = ("rgb", "sRGB", "CIE L*a*b*", "min is black", "Y Cb Cr", "rec-601", "palette", "purple")


@query(f"""SELECT o_orderkey AS id, codec FROM (SELECT o_orderkey, upper(translate([{", ".join(f"'{s}'" for s in SPELLINGS)}][CAST(o_orderkey % {len(SPELLINGS)} AS INTEGER) + 1], ' -', '')) AS name FROM orders)
    LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in [*[(vocab.condensed(c).upper(), c) for c in vocab.CODECS], ("ISO_10918_1", "JPEG"), ("ISO_14495_1", "JPEG-LS"), ("ISO_15444_1", "JPEG 2000")])}) t(name, codec) USING (name)""")
def codec_from_string(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(s) for s in SPELLINGS]), (F.col("o_orderkey") % len(SPELLINGS) + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), vocab.codec_named(name).alias("codec"))


@query(f"""SELECT o_orderkey AS id, color FROM (SELECT o_orderkey, upper(translate([{", ".join(f"'{s}'" for s in COLOR_SPELLINGS)}][CAST(o_orderkey % {len(COLOR_SPELLINGS)} AS INTEGER) + 1], ' -*', '')) AS name FROM orders)
    LEFT JOIN (VALUES ('RGB', 'RGB'), ('SRGB', 'RGB'), ('CIELAB', 'CIE L*a*b*'), ('MINISBLACK', 'Grey'), ('YCBCR', 'YCbCr'), ('REC601', 'YCbCr'), ('PALETTE', 'Palette')) t(name, color) USING (name)""")
def color_from_string(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(s) for s in COLOR_SPELLINGS]), (F.col("o_orderkey") % len(COLOR_SPELLINGS) + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), vocab.color_named(name).alias("color"))


@query("""SELECT id, CASE WHEN compression = 33003 THEN 'YCbCr' WHEN compression = 33005 THEN 'RGB' WHEN p = 0 THEN 'Min is White' WHEN p = 1 THEN 'Grey' WHEN p = 2 THEN 'RGB' WHEN p = 3 THEN 'Palette'
    WHEN p = 5 THEN 'CMYK' WHEN p = 6 THEN 'YCbCr' WHEN p = 8 THEN 'CIE L*a*b*' END AS color
    FROM (SELECT o_orderkey AS id, o_orderkey % 10 AS p, [1, 7, 33003, 33005][CAST(o_orderkey // 10 % 4 AS INTEGER) + 1] AS compression FROM orders)""")
def color_from_tiff(spark, sf_dir):
    compression = F.element_at(F.array(F.lit(1), F.lit(7), F.lit(33003), F.lit(33005)), (grid.whole_div(F.col("o_orderkey"), 10) % 4 + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), vocab.color_of_tiff(F.col("o_orderkey") % 10, compression).alias("color"))


# descriptions

SVS_TEXT = "concat_ws('|', 'Scan of ' || p_brand, 'AppMag = ' || CAST(p_size AS VARCHAR), CASE WHEN p_size % 3 > 0 THEN 'MPP = ' || CAST(p_size AS VARCHAR) || '.5' END, 'Filename = ' || p_name)"


def _described(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    mpp = F.when(F.col("p_size") % 3 > 0, F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    text = svs.build_description(F.concat(F.lit("Scan of "), "p_brand"), {"AppMag": F.col("p_size"), "MPP": mpp, "Filename": F.col("p_name")})
    return part.select(F.col("p_partkey").alias("id"), text.alias("description"))


@query(f"SELECT p_partkey AS id, {SVS_TEXT} AS description FROM part")
def svs_description(spark, sf_dir):
    return _described(spark, sf_dir)


@query(f"""WITH d AS (SELECT p_partkey AS id, {SVS_TEXT} AS t FROM part),
    m AS (SELECT id, map_from_entries([{{k: trim(split_part(p, '=', 1)), v: trim(split_part(p, '=', 2))}} FOR p IN string_split(t, '|') IF contains(p, '=')]) AS m FROM d)
    SELECT id, m['AppMag'] AS app_mag, m['Filename'] AS filename, CAST(m['MPP'] AS DOUBLE) AS mpp FROM m""")
def parse_svs(spark, sf_dir):
    parsed = _described(spark, sf_dir).select("id", svs.parse_description(F.col("description")).alias("m"))
    return parsed.select("id", F.try_element_at("m", F.lit("AppMag")).alias("app_mag"), F.try_element_at("m", F.lit("Filename")).alias("filename"), svs.description_mpp(F.col("m"))["x"].alias("mpp"))


# file types

# Signatures that the queries lay over page headers, as hexadecimal digits.
LAID = ("", "49492A00", "4D4D002B", "FFD8", "89504E470D0A1A0A", "0000000C6A5020200D0A870A", "524946460A00000057454250", "504B0304", "53514C69746520666F726D6174203300")


@query(f"""WITH h AS (SELECT page_id AS id, [{", ".join(f"'{s}'" for s in LAID)}][CAST(page_id % {len(LAID)} AS INTEGER) + 1] || substr(hex(encode(html)), 1, 1600)
      || CASE WHEN page_id % 2 = 0 THEN hex(encode('Aperio')) ELSE hex(encode('<Description> Omnyx')) END AS x FROM pages),
    t AS (SELECT id, starts_with(x, '49492A00') OR starts_with(x, '4D4D002B') AS tiff, starts_with(x, 'FFD8') AS jpeg, starts_with(x, '89504E470D0A1A0A') AS png,
      starts_with(x, '0000000C6A5020200D0A870A') AS jp2, regexp_matches(x, '^52494646........57454250') AS webp, starts_with(x, '504B0304') AS zip, starts_with(x, '53514C69746520666F726D6174203300') AS sqlite,
      id % 2 = 0 AS aperio FROM h)
    SELECT id, concat_ws(',', CASE WHEN tiff THEN 'tiff' END, CASE WHEN jpeg THEN 'jpeg' END, CASE WHEN png THEN 'png' END, CASE WHEN jp2 THEN 'jp2' END, CASE WHEN webp THEN 'webp' END,
      CASE WHEN zip THEN 'zip' END, CASE WHEN sqlite THEN 'sqlite3' END, CASE WHEN tiff AND aperio THEN 'tiff/svs' END, CASE WHEN jp2 AND NOT aperio THEN 'jp2/omnyx' END) AS types FROM t""")
def detect_types(spark, sf_dir):
    sign = F.unhex(F.element_at(F.array(*[F.lit(s) for s in LAID]), (F.col("page_id") % len(LAID) + 1).cast("int")))
    body = F.substring(F.encode("html", "UTF-8"), 1, 800)
    tail = F.encode(F.when(F.col("page_id") % 2 == 0, "Aperio").otherwise("<Description> Omnyx"), "UTF-8")
    content = F.concat(sign, body, tail)
    return fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array_join(magic.type_names(magic.file_types(content)), ",").alias("types"))


@query("""WITH f AS (SELECT page_id % 20 AS d, page_id FROM pages)
    SELECT 'dir' || CAST(d AS VARCHAR) AS dir, CASE WHEN d % 4 = 0 THEN 'zarr,zarr/group' WHEN d % 4 = 1 THEN 'zarr,zarr/array' WHEN d % 4 = 2 THEN 'dicom' ELSE '' END AS types FROM f GROUP BY d""")
def dir_types(spark, sf_dir):
    d = F.col("page_id") % 20
    name = F.when(d % 4 == 0, ".zgroup").when(d % 4 == 1, ".zarray").otherwise(F.concat(F.lit("f"), F.col("page_id").cast("string")))
    header = F.when(d % 4 == 2, F.concat(F.encode(F.repeat(F.lit("-"), 128), "UTF-8"), F.encode(F.lit("DICM"), "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    files = fx.table(spark, sf_dir, "pages").select(F.concat(F.lit("dir"), d.cast("string")).alias("dir"), name.alias("name"), header.alias("header"))
    return magic.directory_types(files).select("dir", F.array_join(magic.type_names(F.col("types")), ",").alias("types"))


# re-gridding, blanks, regions


@query(f"""WITH {GRID_E}, {YIELD} SELECT ty, tx, oy, ox, CAST((least(y1, p1) - greatest(y0, p0)) * (least(x1, q1) - greatest(x0, q0)) AS BIGINT) AS area
    FROM grid JOIN yields ON y0 < p1 AND y1 > p0 AND x0 < q1 AND x1 > q0""")
def regrid_overlap(spark, sf_dir):
    return regrid.overlap_areas(_grid_e(spark, sf_dir), YIELD_H, YIELD_W).select("ty", "tx", "oy", "ox", "area")


@query(f"""WITH {GRID_E}, {YIELD}, a AS (SELECT (event_id * 7919) % (SELECT count(*) FROM events) AS k, ts AS arrival FROM events)
    SELECT oy, ox, count(*) AS n_needed, CASE WHEN count(arrival) = count(*) THEN max(arrival) END AS ready
    FROM grid JOIN yields ON y0 < p1 AND y1 > p0 AND x0 < q1 AND x1 > q0 LEFT JOIN a ON k = ty * 3 + tx AND k % 11 < 10 GROUP BY oy, ox""")
def regrid_ready(spark, sf_dir):
    tiles = order.row_major(_grid_e(spark, sf_dir), -(-WIDTH // TILE_W))
    come = fx.arrivals(spark, sf_dir).filter(F.col("k") % 11 < 10).withColumnRenamed("k", "idx")
    return regrid.ready_times(tiles.join(come, "idx", "left"), YIELD_H, YIELD_W)


def _tiles_l(spark, sf_dir):
    cells = fx.raster_l(spark, sf_dir, 8, 8)
    return cells.groupBy("by", "bx").agg(F.sum("v").alias("v")).withColumnsRenamed({"by": "ty", "bx": "tx"})


def _places_l(spark, sf_dir):
    """ty, tx of the tiles that raster L has, some more than once."""
    return fx.places_l(spark, sf_dir).select(grid.whole_div(F.col("y"), 8).alias("ty"), grid.whole_div(F.col("x"), 8).alias("tx"))


GRID_L = """grid AS (SELECT ty, tx FROM (SELECT unnest(range(0, CAST(ceil(h / 8) AS BIGINT))) AS ty FROM size), (SELECT unnest(range(0, CAST(ceil(w / 8) AS BIGINT))) AS tx FROM size)),
    t AS (SELECT y // 8 AS ty, x // 8 AS tx, CAST(sum(v) AS BIGINT) AS v FROM l GROUP BY ALL)"""


@query(f"WITH {L}, {GRID_L} SELECT ty, tx FROM grid WHERE NOT EXISTS (FROM t WHERE t.ty = grid.ty AND t.tx = grid.tx)")
def blank_tiles(spark, sf_dir):
    return cell_ops.blank_tiles(_places_l(spark, sf_dir), *fx.extent_l(spark, sf_dir), 8, 8, fx.partitions_l(spark, sf_dir)).select("ty", "tx")


@query(f"WITH {L}, {GRID_L} SELECT ty, tx, coalesce(v, 0) AS v FROM grid LEFT JOIN t USING (ty, tx)")
def blank_fill(spark, sf_dir):
    return cell_ops.fill_blanks(_tiles_l(spark, sf_dir), "v", *fx.extent_l(spark, sf_dir), 8, 8, fx.partitions_l(spark, sf_dir))


@query(f"WITH {E} SELECT y, x, v FROM e WHERE y >= 17 AND y < 400 AND x >= 5")
def region_scan(spark, sf_dir):
    return cell_ops.region(fx.raster_e(spark, sf_dir), slice(17, 400), slice(5, None), fx.height_e(spark, sf_dir), WIDTH)


@query(f"""WITH {E}, rows AS (SELECT k AS y, CAST(least(round_even(k * CAST(h AS DOUBLE) / 77, 0), h - 1) AS BIGINT) AS sy FROM size, (SELECT unnest(range(0, 77)) AS k)),
    cols AS (SELECT k AS x, CAST(least(round_even(k * 64.0::DOUBLE / 100, 0), 63) AS BIGINT) AS sx FROM (SELECT unnest(range(0, 100)) AS k))
    SELECT rows.y, cols.x, v FROM rows, cols JOIN e ON e.y = sy AND e.x = sx""")
def resample_nearest(spark, sf_dir):
    return resample.nearest(fx.raster_e(spark, sf_dir), fx.height_e(spark, sf_dir), WIDTH, 77, 100)


@query(f"WITH {E} SELECT y // 4 AS y, x // 4 AS x, v FROM e WHERE y % 4 = 0 AND x % 4 = 0")
def resample_stride(spark, sf_dir):
    return resample.stride(fx.raster_e(spark, sf_dir), 4)


def _area(o: str) -> str:
    """SQL of the area weights of an axis of n cells and m targets: o, s, w."""
    return f"SELECT o, s, least((s + 1) * m, (o + 1) * n) - greatest(s * m, o * n) AS w FROM (SELECT o, n, m, unnest(range(o * n // m, ((o + 1) * n - 1) // m + 1)) AS s FROM {o})"


def _kernel(weight: str):
    """SQL of the weights, whole numbers, of a kernel that widens where the image shrinks."""
    return lambda o: f"SELECT * FROM (SELECT o, s, {weight} AS w FROM (SELECT *, abs(2 * m * s - (2 * o + 1) * n + m) AS far FROM (SELECT o, n, m, unnest(range(0, n)) AS s FROM {o}))) WHERE w > 0"


_linear, _box = _kernel("greatest(0, 2 * greatest(n, m) - far)"), _kernel("CASE WHEN far <= greatest(n, m) THEN 1 ELSE 0 END")


def _spline(o: str) -> str:
    """SQL of the weights between corners."""
    at = f"SELECT o, o * (n - 1) // (m - 1) AS a, o * (n - 1) % (m - 1) AS r, m - 1 AS d FROM {o}"
    return f"SELECT o, a AS s, d - r AS w FROM ({at}) UNION ALL SELECT o, a + 1, r FROM ({at}) WHERE r > 0"


def _resized(axis, to_h: object, to_w: object, cells: str = "e", size: str = "size") -> str:
    """SQL of a resize of ``cells``, whose sides ``size`` has as h and w."""
    return f"""oy AS (SELECT h AS n, {to_h} AS m, unnest(range(0, {to_h})) AS o FROM {size}), ox AS (SELECT w AS n, {to_w} AS m, unnest(range(0, {to_w})) AS o FROM {size}),
        wy AS ({axis("oy")}), wx AS ({axis("ox")}), dy AS (SELECT o, sum(w) AS d FROM wy GROUP BY o), dx AS (SELECT o, sum(w) AS d FROM wx GROUP BY o),
        r AS (SELECT wy.o AS y, x, sum(CAST(v * w AS HUGEINT)) AS v FROM {cells} JOIN wy ON s = y GROUP BY ALL), c AS (SELECT y, o AS x, sum(v * w) AS v FROM r JOIN wx ON s = x GROUP BY ALL)
        SELECT c.y, c.x, CAST((2 * c.v + dy.d * dx.d) // (2 * dy.d * dx.d) AS BIGINT) AS v FROM c JOIN dy ON dy.o = c.y JOIN dx ON dx.o = c.x"""


@query(f"WITH {E}, {_resized(_area, 77, 100)}")
def resize_area(spark, sf_dir):
    return resample.resize(fx.raster_e(spark, sf_dir), fx.height_e(spark, sf_dir), WIDTH, 77, 100, "area").select("y", "x", "v")


@query(f"WITH {E}, {_resized(_linear, 77, 100)}")
def resize_bilinear(spark, sf_dir):
    return resample.resize(fx.raster_e(spark, sf_dir), fx.height_e(spark, sf_dir), WIDTH, 77, 100, "bilinear").select("y", "x", "v")


THIRDS = "CAST(round_even(h / 3.0, 0) AS BIGINT)", "CAST(round_even(w / 3.0, 0) AS BIGINT)"


@query(f"WITH {E}, {_resized(_spline, *THIRDS)}")
def spline_zoom(spark, sf_dir):
    h = fx.height_e(spark, sf_dir)
    made = resample.spline_zoom(_tiles_e(spark, sf_dir).drop("level"), h, WIDTH, round(h / 3), round(WIDTH / 3))
    return cell_ops.tiles_to_cells(made).select("y", "x", "v")


@query(f"""WITH {E} SELECT 'mean' AS method, y // 3 AS y, x // 3 AS x, {BYTE_MEAN} AS v FROM e, size WHERE y < h // 3 * 3 AND x < w // 3 * 3 GROUP BY ALL
    UNION ALL SELECT 'area', * FROM (WITH {_resized(_area, "h // 3", "w // 3")}) UNION ALL SELECT 'box', * FROM (WITH {_resized(_box, "h // 3", "w // 3")}) UNION ALL SELECT 'spline', * FROM (WITH {_resized(_spline, *THIRDS)})""")
def downsample_methods(spark, sf_dir):
    cells, h = fx.raster_e(spark, sf_dir), fx.height_e(spark, sf_dir)
    made = [resample.downsample(cells, h, WIDTH, 3, m).select(F.lit(m).alias("method"), "y", "x", "v") for m in resample.METHODS]
    return functools.reduce(DataFrame.unionByName, made)


@query(f"""WITH {E}, fit AS (SELECT h, w, CAST(pow(2, floor(log2(greatest(h / 100.0, w / 16.0)))) AS BIGINT) AS step, CASE WHEN 100 * w <= 16 * h THEN 100 ELSE h * 16 // w END AS th, CASE WHEN 100 * w <= 16 * h THEN w * 100 // h ELSE 16 END AS tw FROM size),
    strided AS (SELECT y // step AS y, x // step AS x, v FROM e, fit WHERE y % step = 0 AND x % step = 0), sides AS (SELECT CAST(ceil(h / step) AS BIGINT) AS h, CAST(ceil(w / step) AS BIGINT) AS w, th, tw FROM fit), {_resized(_linear, "th", "tw", "strided", "sides")}""")
def thumbnail_fit(spark, sf_dir):
    return resample.thumbnail_fit(fx.raster_e(spark, sf_dir), fx.height_e(spark, sf_dir), WIDTH, 100, 16).select("y", "x", "v")


# frames and order


@query("""WITH f AS (SELECT doc_id AS i, CAST(octet_length(encode(text)) AS BIGINT) AS len FROM documents)
    SELECT i, len, len + len % 2 AS padded_len, CAST(coalesce(sum(len + len % 2 + 8) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM f""")
def frame_offsets(spark, sf_dir):
    return frame_ops.frame_offsets(fx.frames(spark, sf_dir).select("i", "len"))


@query("""WITH a AS (SELECT (event_id * 7919) % (SELECT count(*) FROM events) AS k, ts AS arrival FROM events)
    SELECT k, arrival, max(arrival) OVER (ORDER BY k) AS released FROM a""")
def in_order_release(spark, sf_dir):
    return order.release_times(fx.arrivals(spark, sf_dir))


@query("SELECT doc_id AS i, md5(text) AS before_md5, md5(text) AS after_md5, CAST(octet_length(encode(text)) AS BIGINT) AS len FROM documents")
def transcode_passthrough(spark, sf_dir):
    """Encoded frames as they are into packs and back; the sum of what was sent rides as the slide's name."""
    sent = fx.frames(spark, sf_dir).withColumn("slide_id", F.md5("payload"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tiles = sent.select("slide_id", F.lit(0).alias("level"), F.col("i").alias("ty"), none.alias("tx"), F.col("i").alias("y0"), none.alias("x0"), one.alias("h"), F.col("len").alias("w"), one.alias("c"), "payload")
    path = files.shared_path(spark, "frames")
    chunks.write_chunks(tiles, path)
    back = chunks.read_chunks(spark, path)
    return back.select(F.col("ty").alias("i"), F.col("slide_id").alias("before_md5"), F.md5("payload").alias("after_md5"), F.octet_length("payload").cast("bigint").alias("len"))


# the table source and sink


def _tiles_e(spark, sf_dir, level: int = 0):
    """Raster E in packed tiles."""
    cells = fx.raster_e(spark, sf_dir).withColumns({"slide_id": F.lit("e"), "c": F.lit(0).cast("bigint")})
    tiles = cell_ops.cells_to_tiles(cells, TILE_H, TILE_W, fx.height_e(spark, sf_dir), WIDTH, 1)
    return tiles.withColumn("level", F.lit(level))


def _stored_e(spark, sf_dir) -> str:
    path = files.shared_path(spark, "tiles")
    chunks.write_chunks(_tiles_e(spark, sf_dir), path, pack_bytes=1 << 13)
    return path


@query(f"WITH {E} SELECT y, x, v FROM e")
def tile_source_scan(spark, sf_dir):
    return cell_ops.tiles_to_cells(chunks.read_chunks(spark, _stored_e(spark, sf_dir))).select("y", "x", "v")


@query(f"WITH {E} SELECT y, x, v FROM e WHERE y >= 17 AND y < 130 AND x >= 5 AND x < 40")
def region_source_scan(spark, sf_dir):
    tiles = chunks.read_region(spark, _stored_e(spark, sf_dir), 0, slice(17, 130), slice(5, 40), TILE_H, TILE_W, task_bytes=1 << 13)
    return cell_ops.tiles_to_cells(tiles).select("y", "x", "v")


@query(f"WITH {E} SELECT y, x, CASE WHEN (y // {TILE_H} + x // {TILE_W}) % 3 = 0 THEN 255 - v ELSE v END AS v FROM e")
def chunk_overwrite(spark, sf_dir):
    """Every third tile is written again, with its complement; the others are as they were."""
    path = _stored_e(spark, sf_dir)
    cells = fx.raster_e(spark, sf_dir).filter((grid.whole_div(F.col("y"), TILE_H) + grid.whole_div(F.col("x"), TILE_W)) % 3 == 0)
    cells = cells.select(F.lit("e").alias("slide_id"), "y", "x", F.lit(0).cast("bigint").alias("c"), (255 - F.col("v")).alias("v"))
    changed = cell_ops.cells_to_tiles(cells, TILE_H, TILE_W, fx.height_e(spark, sf_dir), WIDTH, 1)
    chunks.write_chunks(changed.withColumn("level", F.lit(0)), path, "append")
    return cell_ops.tiles_to_cells(chunks.read_chunks(spark, path)).select("y", "x", "v")


SPARSE = """n AS (SELECT CAST(ceil(h / 2) AS BIGINT) AS down, CAST(ceil(w / 2) AS BIGINT) AS across FROM size),
    have AS (SELECT DISTINCT y // 2 * across + x // 2 AS idx FROM l, n),
    lack AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS run FROM (SELECT unnest(range(0, down * across)) AS idx FROM n) WHERE idx NOT IN (SELECT idx FROM have)),
    runs AS (SELECT min(idx) AS first, max(idx) AS last FROM lack GROUP BY run)"""


def _sparse_l(spark, sf_dir):
    """The tiles of two by two cells that raster L has, some more than once, and its extents."""
    cells = fx.places_l(spark, sf_dir)
    tiles = cells.select(F.lit("l").alias("slide_id"), F.lit(0).alias("level"), grid.whole_div(F.col("y"), 2).alias("ty"), grid.whole_div(F.col("x"), 2).alias("tx"))
    return tiles, *fx.extent_l(spark, sf_dir)


@query(f"WITH {L}, {SPARSE} SELECT 'l' AS slide_id, CAST(0 AS INTEGER) AS level, down * across AS n_tiles, (SELECT count(*) FROM have) AS n_present, (SELECT count(*) FROM runs) AS n_runs, (SELECT count(*) FROM have) = down * across AS whole FROM n")
def layout_coverage(spark, sf_dir):
    tiles, h, w = _sparse_l(spark, sf_dir)
    return coverage.layout_summary(tiles, h, w, 2, 2, fx.partitions_l(spark, sf_dir))


@query(f"WITH {L}, {SPARSE} SELECT first, last FROM runs")
def layout_missing_runs(spark, sf_dir):
    tiles, h, w = _sparse_l(spark, sf_dir)
    return coverage.missing_runs(tiles, h, w, 2, 2, fx.partitions_l(spark, sf_dir)).select("first", "last")


DATASETS = " || ',' || ".join(
    f"""json_object('path', '{k}', 'coordinateTransformations', CASE WHEN id % 5 > 0 THEN json_array(json_object('type', 'scale', 'scale', json_array(mpp * {d}, mpp * {d}, 1.0::DOUBLE))) ELSE json_array(json_object('type', 'identity')) END)"""
    for k, d in ((0, 1), (1, 2), (2, 4))
)
CHANNELS = ",".join(f'{{"active":true,"coefficient":1.0,"color":"{color}","family":"linear","inverted":false,"label":"{label}","window":{{"end":255.0,"max":255.0,"min":0.0,"start":0.0}}}}' for label, color in (("Red", "FF0000"), ("Green", "00FF00"), ("Blue", "0000FF")))
ZATTRS = f"""'{{"_creator":{{"name":"mosaiq","version":"0.1.0"}},"multiscales":[{{"axes":[{{"name":"y","type":"space","unit":"micrometer"}},{{"name":"x","type":"space","unit":"micrometer"}},{{"name":"c","type":"channel"}}],"datasets":['
    || {DATASETS} || '],"version":"0.4"}}],"_ARRAY_DIMENSIONS":["y","x","c"],"omero":{{"name":"image","id":1,"channels":[{CHANNELS}],"rdefs":{{"defaultT":0,"defaultZ":0,"model":"color"}},"version":"0.4"}}}}'"""


@query(f"WITH {R} SELECT id, {ZATTRS} AS zattrs FROM r")
def ngff_metadata(spark, sf_dir):
    from mosaiq.functions.ngff import zattrs_json

    levels = [(0, 1), (1, 2), (2, 4)]
    resolved = fx.resolutions(spark, sf_dir).select("id", zattrs_json(levels, F.when(F.col("id") % 5 > 0, F.col("mpp")), F.col("mpp")).alias("zattrs"))
    return resolved


# tile kernels: the packed form gives the same as the cells do


@query(f"WITH {E} SELECT y // {TILE_H} * ({TILE_H} // 4) + y % {TILE_H} // 4 AS y, x // {TILE_W} * ({TILE_W} // 4) + x % {TILE_W} // 4 AS x, {BYTE_MEAN} AS v FROM e, size WHERE y < h // 4 * 4 AND x < w // 4 * 4 GROUP BY ALL")
def tile_pool(spark, sf_dir):
    cells = fx.raster_e(spark, sf_dir).withColumns({"slide_id": F.lit("e"), "c": F.lit(0).cast("bigint")})
    tiles = cell_ops.cells_to_tiles(cells, TILE_H, TILE_W, fx.height_e(spark, sf_dir), WIDTH, 1)
    return cell_ops.tiles_to_cells(cell_ops.pool_tiles(tiles, 4, TILE_H, TILE_W)).select("y", "x", "v")


@query(f"WITH {E} SELECT y, x, v FROM e")
def tile_regrid(spark, sf_dir):
    h = fx.height_e(spark, sf_dir)
    cells = fx.raster_e(spark, sf_dir).withColumns({"slide_id": F.lit("e"), "c": F.lit(0).cast("bigint")})
    tiles = cell_ops.cells_to_tiles(cells, TILE_H, TILE_W, h, WIDTH, 1)
    return cell_ops.tiles_to_cells(regrid.regrid_tiles(tiles, YIELD_H, YIELD_W, h, WIDTH)).select("y", "x", "v")


# expectations, reducers and table functions

SLIDES = """s AS (SELECT p_partkey AS id, 16 * (p_size % 5 + 1) + CASE WHEN p_partkey % 7 = 0 THEN 8 ELSE 0 END AS tile_h, 16 * (p_size % 3 + 1) AS tile_w,
    CASE WHEN p_partkey % 5 > 0 THEN p_size / 20.0::DOUBLE END AS mpp, CASE p_partkey % 3 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'Zstd' END AS codec, p_partkey % 4 AS k FROM part)"""


def _slides(spark, sf_dir):
    """Headers of slides, one a part."""
    part, id_ = fx.table(spark, sf_dir, "part"), F.col("p_partkey")
    tile_h = 16 * (F.col("p_size") % 5 + 1) + F.when(id_ % 7 == 0, 8).otherwise(0)
    mpp = F.when(id_ % 5 > 0, F.col("p_size") / 20.0)
    levels = F.when(id_ % 4 == 0, F.array()).when(id_ % 4 == 1, F.array(F.lit(2), F.lit(4))).when(id_ % 4 == 2, F.array(F.lit(2), F.lit(8))).otherwise(F.array(F.lit(4)))
    sides = F.when(id_ % 4 == 3, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))
    return part.select(
        id_.alias("id"), tile_h.alias("tile_h"), (16 * (F.col("p_size") % 3 + 1)).alias("tile_w"), mpp.alias("mpp_y"), mpp.alias("mpp_x"), F.when(id_ % 3 == 0, "JPEG").when(id_ % 3 == 1, "Zstd").alias("codec"),
        F.lit(96).alias("read_tile_h"), F.lit(96).alias("read_tile_w"), levels.cast("array<int>").alias("downsamples"), sides.alias("size"), F.array(F.lit(1), F.lit(2)).alias("tile"),
        (F.col("p_size") * 2).alias("ppu_y"), (F.col("p_size") % 9).alias("ppu_x"), (id_ % 2 + 2).alias("unit"),
    )


@query(f"""WITH {SLIDES} SELECT id, tile_h % 16 = 0 AND tile_w % 16 = 0 AS tile_sides, mpp IS NOT NULL AS has_resolution,
    coalesce(NOT ((1.0::DOUBLE / mpp) * 1e3 = 1 OR (1.0::DOUBLE / mpp) * 1e4 = 1 OR (1.0::DOUBLE / mpp) * 25400.0 IN (1, 72, 150, 300, 1200, 2400) OR mpp > 5), TRUE) AS resolution,
    k < 2 AS powers_of_two, coalesce(codec <> 'JPEG', TRUE) OR 96 % tile_h = 0 AND 96 % tile_w = 0 AS whole_lossy_tiles, k <> 3 AS ranks,
    NOT (id % 2 + 2 = 2 AND (p_size * 2 = 72 OR p_size % 9 = 72)) AS no_default_ppi, p_size * 2 <> 0 AND p_size % 9 <> 0 AS no_zero FROM s JOIN part ON p_partkey = id""")
def slide_validation(spark, sf_dir):
    """Every rule on every header in one pass; what breaks is counted by an observation of the same job."""
    rules = {r.name: r for found in (expectations.tiff_rules(), expectations.dicom_rules(), expectations.pyramid_rules(), expectations.lossy_rules(), expectations.resolution_tag_rules()) for r in found}
    return expectations.verdicts(_slides(spark, sf_dir), list(rules.values()), ["id"])


@query(f"""WITH {E}, r AS (SELECT y // 5 AS y, x // 3 AS x, v, row_number() OVER (PARTITION BY y // 5, x // 3 ORDER BY v) AS k, count(*) OVER (PARTITION BY y // 5, x // 3) AS n FROM e)
    SELECT y, x, v FROM r WHERE k = (n + 1) // 2""")
def block_reduce_custom(spark, sf_dir):
    return reducers.block_reduce_custom(fx.raster_e(spark, sf_dir), 5, 3, reducers.Median())


@query(f"WITH {GRID_E} SELECT * FROM grid")
def tile_cover(spark, sf_dir):
    table_functions.register(spark)
    sized = fx.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("h"))
    return spark.sql(f"SELECT t.* FROM {{sized}} s, LATERAL tile_cover(s.h, {WIDTH}, {TILE_H}, {TILE_W}) t", sized=sized)


@query(f"""WITH {L}, t AS (SELECT DISTINCT 's' || CAST(y // 2 % 3 AS VARCHAR) AS slide_id, y // 2 AS ty, x // 2 AS tx FROM l)
    SELECT slide_id, ty, tx, row_number() OVER (PARTITION BY slide_id ORDER BY ty, tx) - 1 AS place, tx - coalesce(lag(tx) OVER (PARTITION BY slide_id, ty ORDER BY tx), -1) - 1 AS gap FROM t""")
def tile_walk(spark, sf_dir):
    table_functions.register(spark)
    tiles, _, _ = _sparse_l(spark, sf_dir)
    tiles = tiles.withColumn("slide_id", F.concat(F.lit("s"), (F.col("ty") % 3).cast("string"))).drop("level")
    tiles = table_functions.banded(tiles, fx.partitions_l(spark, sf_dir))
    return spark.sql("SELECT * FROM tile_walk(TABLE({tiles}))", tiles=tiles)


# streams


def _ended(stream: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """What a stream has written when nothing is left to read."""
    running = stream.writeStream.format("parquet").outputMode("append").options(path=f"{path}/out", checkpointLocation=f"{path}/checkpoint").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("""WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT event_id % 8 AS s, event_id // 8 AS i, (n + 7 - event_id % 8) // 8 AS m FROM events, n)
    SELECT 's' || CAST(s AS VARCHAR) AS slide_id, (i * 7919) % m AS k, (i * 7919) % m AS place FROM e""")
def stream_release(spark, sf_dir):
    """Events as tiles of eight slides, each of which leaves in order, whatever the order in which they come."""
    n = fx.table(spark, sf_dir, "events").count()
    events = spark.readStream.schema("event_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    slide, i = F.col("event_id") % 8, grid.whole_div(F.col("event_id"), 8)
    m = grid.whole_div(n + 7 - slide, 8)
    tiles = events.select(F.concat(F.lit("s"), slide.cast("string")).alias("slide_id"), ((i * 7919) % m).alias("k"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("payload"), m.alias("n_tiles"))
    return _ended(reorder.release_in_order(tiles), spark, files.shared_path(spark, "release")).select("slide_id", "k", "place")


@query(f"WITH {E} SELECT y, x, v FROM e")
def stream_bounded(spark, sf_dir):
    """Raster E from its packs as a stream of at most 64 tiles a micro-batch."""
    path = files.shared_path(spark, "stream")
    tiles = chunks.stream_chunks(spark, _stored_e(spark, sf_dir), 64, f"{path}/checkpoint")
    return cell_ops.tiles_to_cells(_ended(tiles, spark, path)).select("y", "x", "v")
