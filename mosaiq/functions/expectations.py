"""Expectations on frames: rules as columns, all judged in one pass, counted beside the job that reads the frame.

``observed`` adds an ``Observation`` whose figures are there when any action on the frame has run, without a
job of their own; rules that are fatal end that job at the first row that breaks them. A rule holds for a
row unless it is false; null counts as held, as a check of what is not there says nothing.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mosaiq.functions import units

# Codecs that lose detail, and the units of resolutions in TIFF files.
LOSSY = ("JPEG",)
INCH, DEFAULT_PPI = 2, 72


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column
    message: str
    fatal: bool = False

    @property
    def held(self) -> Column:
        return F.coalesce(self.ok, F.lit(True))


def tiff_rules() -> list[Rule]:
    """Of tile_h, tile_w, mpp_y, mpp_x."""
    return [
        Rule("tile_sides", (F.col("tile_h") % 16 == 0) & (F.col("tile_w") % 16 == 0), "tile sides must be multiples of 16", fatal=True),
        Rule("has_resolution", F.col("mpp_y").isNotNull() & F.col("mpp_x").isNotNull(), "no resolution is written"),
        Rule("resolution", units.plausible_mpp(F.col("mpp_y")) & units.plausible_mpp(F.col("mpp_x")), "the resolution is likely a default or a print size"),
    ]


def dicom_rules() -> list[Rule]:
    """Of mpp_y, mpp_x and the arrays size, tile."""
    return [
        Rule("has_resolution", F.col("mpp_y").isNotNull() & F.col("mpp_x").isNotNull(), "the resolution is required; 1000 microns are taken"),
        Rule("resolution", units.plausible_mpp(F.col("mpp_y")) & units.plausible_mpp(F.col("mpp_x")), "the resolution is likely a default or a print size"),
        Rule("ranks", (F.size("size") == 2) & (F.size("tile") == 2), "size and tile must have two sides", fatal=True),
    ]


def pyramid_rules() -> list[Rule]:
    """Of the array downsamples: consecutive powers of two, as one container asks."""
    powers = F.transform(F.col("downsamples"), lambda d, i: d == F.pow(F.lit(2.0), i + 1))
    return [Rule("powers_of_two", F.forall(powers, lambda ok: ok), "downsamples must be consecutive powers of two", fatal=True)]


def lossy_rules() -> list[Rule]:
    """Of codec, tile_h, tile_w, read_tile_h, read_tile_w: a lossy tile is written from whole tiles only."""
    whole = (F.col("read_tile_h") % F.col("tile_h") == 0) & (F.col("read_tile_w") % F.col("tile_w") == 0)
    return [Rule("whole_lossy_tiles", ~F.col("codec").isin(*LOSSY) | whole, "lossy tiles must divide the tiles that are read", fatal=True)]


def resolution_tag_rules() -> list[Rule]:
    """Of ppu_y, ppu_x, unit as a TIFF file has them."""
    ppu = (F.col("ppu_y"), F.col("ppu_x"))
    return [
        Rule("no_default_ppi", ~((F.col("unit") == INCH) & ((ppu[0] == DEFAULT_PPI) | (ppu[1] == DEFAULT_PPI))), "72 pixels an inch are a default"),
        Rule("no_zero", (ppu[0] != 0) & (ppu[1] != 0), "a resolution is zero"),
    ]


def verdicts(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """Whether each row holds each rule."""
    return df.select(*keys, *[r.held.alias(r.name) for r in rules])


def observed(df: DataFrame, rules: list[Rule], name: str) -> tuple[DataFrame, Observation]:
    """The frame as it is, and the observation of its rows: n_rows, and for each rule how many break it."""
    seen = Observation(name)
    counted = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~r.held).alias(r.name) for r in rules])
    for r in rules:
        if r.fatal:
            counted = counted.filter(F.when(r.held, F.lit(True)).otherwise(F.raise_error(F.lit(f"{r.name}: {r.message}")).cast("boolean")))
    return counted, seen


def warn_broken(seen: Observation, rules: list[Rule]) -> dict[str, int]:
    """After an action: warns of each rule that rows broke; their numbers."""
    broken = {r.name: seen.get[r.name] for r in rules if seen.get[r.name]}
    for r in rules:
        if r.name in broken:
            warnings.warn(f"{r.name}: {r.message} ({broken[r.name]} of {seen.get['n_rows']} rows)", stacklevel=2)
    return broken


def check_resolution(mpp: tuple[float, float] | None, required: bool = False) -> bool:
    """Of one header, on the driver: warns of a resolution that is missing or doubtful."""
    if mpp is None:
        warnings.warn("no resolution; 1000 microns are taken" if required else "no resolution is written", stacklevel=3)
        return False
    fine = all(units.check_mpp(m) for m in mpp)
    if not fine:
        warnings.warn(f"the resolution {mpp} is likely a default or a print size", stacklevel=3)
    return fine
