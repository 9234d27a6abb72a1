"""Command line: convert, transcode, thumbnail, identify."""

from __future__ import annotations

import argparse
import sys

from mosaiq import __version__


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("mosaiq")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    pair = {"nargs": 2, "type": int}
    c = commands.add_parser("convert")
    c.add_argument("-i", "--in-path", required=True)
    c.add_argument("-o", "--out-path", required=True)
    c.add_argument("-t", "--tile-size", default=(256, 256), metavar=("WIDTH", "HEIGHT"), **pair)
    c.add_argument("-c", "--codec", default="deflate")
    c.add_argument("-cl", "--compression-level", type=int)
    c.add_argument("-d", "--downsample", type=int, action="append", default=[])
    c.add_argument("-mpp", "--microns-per-pixel", nargs=2, type=float, metavar=("X", "Y"))
    c.add_argument("-W", "--writer", choices=("tiff", "zarr", "dicom"))
    c.add_argument("-s", "--store", choices=("dir", "ndir", "zip", "sqlite"))
    c.add_argument("--overwrite", action="store_true")
    t = commands.add_parser("transcode")
    t.add_argument("-i", "--in-path", required=True)
    t.add_argument("-o", "--out-path", required=True)
    t.add_argument("--overwrite", action="store_true")
    n = commands.add_parser("thumbnail")
    n.add_argument("-i", "--in-path", required=True)
    n.add_argument("-o", "--out-path", required=True)
    which = n.add_mutually_exclusive_group(required=True)
    which.add_argument("-s", "--size", metavar=("WIDTH", "HEIGHT"), **pair)
    which.add_argument("-d", "--downsample", type=int)
    n.add_argument("-a", "--approx-ok", action="store_true")
    n.add_argument("--overwrite", action="store_true")
    commands.add_parser("identify").add_argument("path")
    return parser


def main(args: list[str] | None = None) -> int:
    given = _parser().parse_args(args)
    from mosaiq.functions import vocab
    from mosaiq.plans import convert as plans

    try:
        if given.command == "identify":
            kinds = plans.identify(given.path)
            print("\n".join(kinds) or "unknown")
            return 0 if kinds else 2
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        if given.command == "convert":
            mpp = given.microns_per_pixel
            plans.convert(spark, given.in_path, given.out_path, tuple(given.tile_size[::-1]), vocab.codec(given.codec), given.compression_level, given.downsample, mpp and (mpp[1], mpp[0]), None, given.writer, given.store, given.overwrite)
        elif given.command == "transcode":
            plans.transcode(spark, given.in_path, given.out_path, None, given.overwrite)
        else:
            plans.thumbnail(spark, given.in_path, given.out_path, given.size and tuple(given.size[::-1]), given.downsample, given.approx_ok, given.overwrite)
    except (ValueError, FileExistsError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
