from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import cli
from mosaiq.operators import cells as cell_ops
from mosaiq.plans import convert as plans
from mosaiq.sources import codecs, dicom, tiff, zarr
from mosaiq.sources.slide import Slide, decode_tiles, encode_tiles

H, W = 75, 53


@pytest.fixture(scope="module")
def image():
    y, x = np.mgrid[:H, :W]
    return np.stack([y * 3 % 256, x * 5 % 256, (y // 8 + x // 8) % 2 * 255], axis=2).astype(np.uint8)


def slide_of(spark, image, tile_h, tile_w, codec, mpp=(0.25, 0.5)):
    rows = []
    for ty in range(-(-H // tile_h)):
        for tx in range(-(-W // tile_w)):
            part = image[ty * tile_h : (ty + 1) * tile_h, tx * tile_w : (tx + 1) * tile_w]
            rows.append(("s", ty, tx, ty * tile_h, tx * tile_w, *part.shape, bytearray(part.tobytes())))
    made = Slide("s", H, W, 3, tile_h, tile_w, codec, "RGB", mpp)
    made.tiles = encode_tiles(spark.createDataFrame(rows, cell_ops.TILE), made)
    return made


def pixels(slide, level=0):
    h, w = slide.level_shape(slide.downsamples[level])
    out = np.zeros((h, w, slide.channels), np.uint8)
    for t in decode_tiles(slide, level).collect():
        out[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.frombuffer(bytes(t.payload), np.uint8).reshape(t.h, t.w, t.c)
    return out


@pytest.mark.parametrize("codec", sorted(codecs.ENCODE))
def test_codecs_round_trip(codec):
    rng = random.Random(1)
    for data in (b"", b"a", b"aaaa" * 100, bytes(rng.randrange(256) for _ in range(1000)), b"aab" * 200 + b"x" * 300):
        assert codecs.decode(codec, codecs.encode(codec, data)) == data
    with pytest.raises(ValueError, match="passed through"):
        codecs.decode("JPEG", b"")


def test_lzw_decodes_a_stream_with_wider_codes():
    data = bytes(random.Random(2).randrange(256) for _ in range(3000)) + b"abc" * 300
    table, width, bits = {bytes((k,)): k for k in range(256)}, 9, []
    bits.append((256, 9))
    size, word = 258, b""
    for k in range(len(data)):
        one = data[k : k + 1]
        if word + one in table:
            word += one
            continue
        bits.append((table[word], width))
        table[word + one], size = size, size + 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size >= 4094:
            bits.append((256, width))
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
        word = one
    bits += [(table[word], width), (257, width)]
    text = "".join(f"{c:0{w}b}" for c, w in bits)
    text += "0" * (-len(text) % 8)
    assert codecs.decode("LZW", int(text, 2).to_bytes(len(text) // 8, "big")) == data


@pytest.mark.parametrize("store", zarr.STORES)
def test_zarr_round_trip(spark, image, tmp_path, store):
    path = str(tmp_path / "a.zarr")
    zarr.write_zarr(slide_of(spark, image, 16, 24, "Zlib"), path, store)
    back = plans.open_slide(spark, path)
    assert (back.height, back.width, back.tile_h, back.tile_w, back.codec, back.mpp) == (H, W, 16, 24, "Zlib", (0.25, 0.5))
    assert (pixels(back) == image).all()
    with pytest.raises(FileExistsError):
        zarr.write_zarr(slide_of(spark, image, 16, 24, "Zlib"), path, store)


def test_blank_tiles_read_as_zeros(spark, image, tmp_path):
    slide = slide_of(spark, image, 16, 16, "Zstd")
    slide.tiles = slide.tiles.filter("ty <> 1")
    zarr.write_zarr(slide, str(tmp_path / "b.zarr"))
    back = pixels(plans.open_slide(spark, str(tmp_path / "b.zarr")))
    assert not back[16:32].any() and (back[32:] == image[32:]).all()


@pytest.mark.parametrize("codec", ["None", "DEFLATE", "PackBits", "Zstd"])
def test_tiff_round_trip(spark, image, tmp_path, codec):
    path = str(tmp_path / "a.tiff")
    tiff.write_tiff(slide_of(spark, image, 16, 32, codec), path, description="made by a test")
    back = plans.open_slide(spark, path)
    assert back.codec == codec and back.color == "RGB" and np.allclose(back.mpp, (0.25, 0.5), rtol=1e-3)
    assert (pixels(back) == image).all()
    with pytest.raises(ValueError, match="16"):
        tiff.write_tiff(slide_of(spark, image, 10, 32, codec), path, overwrite=True)


def test_ome_is_refused(spark, image, tmp_path):
    with pytest.raises(ValueError, match="OME"):
        plans.writer_of("a.OME.tiff")


def test_tables_join_a_frame():
    assert tiff.with_tables(b"\xff\xd8TABLES\xff\xd9", b"\xff\xd8FRAME\xff\xd9") == b"\xff\xd8TABLESFRAME\xff\xd9"
    assert tiff.with_tables(None, b"frame") == b"frame"


def test_tiff_of_a_predictor_is_refused(spark, image, tmp_path):
    path = tmp_path / "a.tiff"
    tiff.write_tiff(slide_of(spark, image, 16, 32, "DEFLATE"), str(path))
    data = bytearray(path.read_bytes())
    at = data.index(b"\x1c\x01\x03\x00")  # the planar entry becomes a predictor of 2
    data[at : at + 2], data[at + 12] = (317).to_bytes(2, "little"), 2
    path.write_bytes(data)
    with pytest.raises(ValueError, match="predictor"):
        tiff.read_tiff(spark, str(path))


@pytest.mark.parametrize("target", ["p.tiff", "p.zarr"])
def test_convert_regrids_and_builds_levels(spark, image, tmp_path, target):
    first, second = str(tmp_path / "a.zarr"), str(tmp_path / target)
    zarr.write_zarr(slide_of(spark, image, 20, 12, "Zlib"), first)
    plans.convert(spark, first, second, (32, 16), downsamples=[2, 4])
    back = plans.open_slide(spark, second)
    assert (back.tile_h, back.tile_w, back.downsamples) == (32, 16, [1, 2, 4]) and (pixels(back) == image).all()
    mean = lambda a, f: (a[: a.shape[0] // f * f, : a.shape[1] // f * f].reshape(a.shape[0] // f, f, a.shape[1] // f, f, 3).astype(float).mean(axis=(1, 3))).astype(np.uint8)
    assert (pixels(back, 1) == mean(image, 2)).all()
    assert (pixels(back, 2) == (mean(image, 4) if target == "p.tiff" else mean(mean(image, 2), 2))).all()


def _opaque(spark, codec="JPEG"):
    made = Slide("s", 40, 30, 3, 16, 16, codec, "YCbCr", (0.5, 0.5))
    rows = [("s", 0, 1, ty, tx, codec, bytearray(b"\xff\xd8" + bytes((ty, tx)) * (ty + 2 * tx) + b"x" * (tx % 2))) for ty in range(3) for tx in range(2)]
    made.tiles = spark.createDataFrame(rows, "slide_id string, level int, downsample int, ty bigint, tx bigint, codec string, payload binary")
    return made, {(r[3], r[4]): bytes(r[6]) for r in rows}


def _payloads(slide):
    return {(r.ty, r.tx): bytes(r.payload) for r in slide.tiles.collect()}


def test_dicom_round_trip_and_transcoding_pass_payloads(spark, tmp_path):
    slide, want = _opaque(spark)
    path = str(tmp_path / "a.dcm")
    dicom.write_dicom(slide, path)
    assert plans.identify(path) == ["dcm"]
    back = plans.open_slide(spark, path)
    even = {k: v + b"\0" * (len(v) % 2) for k, v in want.items()}
    assert (back.height, back.width, back.codec, back.mpp) == (40, 30, "JPEG", (0.5, 0.5)) and _payloads(back) == even
    for target in ("t.tiff", "t.zarr", "t.dcm"):
        plans.transcode(spark, path, str(tmp_path / target))
        assert _payloads(plans.open_slide(spark, str(tmp_path / target))) == even
    slide.tiles = slide.tiles.filter("ty < 2")
    with pytest.raises(ValueError, match="6 frames"):
        dicom.write_dicom(slide, str(tmp_path / "b.dcm"))


def test_sinks_tell_of_doubtful_resolutions_and_folders_are_published_whole(spark, image, tmp_path):
    with pytest.warns(UserWarning, match="print size"):
        tiff.write_tiff(slide_of(spark, image, 16, 16, "DEFLATE", mpp=(25400 / 72, 0.5)), str(tmp_path / "a.tiff"))
    path = str(tmp_path / "z.zarr")
    zarr.write_zarr(slide_of(spark, image, 16, 16, "Zlib"), path)
    broken = slide_of(spark, 255 - image, 16, 16, "Zlib")
    broken.tiles = broken.tiles.withColumn("payload", F.when((F.col("ty") == 3) & (F.col("tx") == 1), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        zarr.write_zarr(broken, path, overwrite=True)
    assert (pixels(plans.open_slide(spark, path)) == image).all()
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []


def test_transcoding_refuses_what_cannot_pass(spark, image, tmp_path):
    tiff.write_tiff(slide_of(spark, image, 16, 16, "DEFLATE"), str(tmp_path / "a.tiff"))
    with pytest.raises(ValueError, match="cannot pass"):
        plans.transcode(spark, str(tmp_path / "a.tiff"), str(tmp_path / "a.dcm"))


def test_thumbnail_is_a_png_near_the_area_mean(spark, image, tmp_path):
    zarr.write_zarr(slide_of(spark, image, 16, 16, "Zlib"), str(tmp_path / "a.zarr"))
    out = tmp_path / "t.png"
    plans.thumbnail(spark, str(tmp_path / "a.zarr"), str(out), downsample=4)
    data = out.read_bytes()
    assert struct.unpack(">II", data[16:24]) == (W // 4, H // 4)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    got = np.frombuffer(raw, np.uint8).reshape(H // 4, 1 + W // 4 * 3)[:, 1:].reshape(H // 4, W // 4, 3)
    assert got.std() > 0
    with pytest.raises(ValueError, match="either"):
        plans.thumbnail(spark, str(tmp_path / "a.zarr"), str(out))


def test_writers_by_suffix():
    assert [plans.writer_of(p) for p in ("a.OME.zarr", "b.zarr.zip", "c.dcm", "d.ngff", "e/")[:4]] == ["zarr", "zarr", "dicom", "zarr"]
    with pytest.raises(ValueError, match="no writer"):
        plans.writer_of("a.jpg")


def test_command_line(spark, image, tmp_path, capsys):
    first = str(tmp_path / "a.zarr")
    zarr.write_zarr(slide_of(spark, image, 16, 16, "Zlib"), first)
    assert cli.main(["identify", first]) == 0 and "zarr/group" in capsys.readouterr().out
    assert cli.main(["convert", "-i", first, "-o", str(tmp_path / "b.tiff"), "-t", "16", "32", "-d", "2"]) == 0
    assert (pixels(plans.open_slide(spark, str(tmp_path / "b.tiff"))) == image).all()
    assert cli.main(["convert", "-i", first, "-o", str(tmp_path / "b.tiff")]) == 2
    assert cli.main(["thumbnail", "-i", first, "-o", str(tmp_path / "t.png"), "-s", "10", "12"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["thumbnail", "-i", first, "-o", "x.png"])
