"""Resolutions: microns per pixel, pixels per unit, and checks of plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microns in a unit; TIFF's units 2 (inch) and 3 (centimetre) by number.
MICRONS = {"um": 1.0, "µm": 1.0, "micron": 1.0, "micrometer": 1.0, "mm": 1e3, "cm": 1e4, "m": 1e6, "inch": 25400.0, "2": 25400.0, "3": 1e4}
# Resolutions in pixels per inch that scanners of paper and screens write.
PRINT_PPI = (1, 72, 150, 300, 1200, 2400)
# Magnifications that microscopes are said to have.
MAGNIFICATIONS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 20.0, 40.0, 50.0, 60.0, 80.0, 100.0, 125.0, 150.0, 200.0, 250.0, 312.5, 375.0, 500.0, 600.0, 750.0, 1000.0, 1250.0)
WIDEST_MPP = 5.0


def microns(unit: Column) -> Column:
    """Microns in a unit; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in MICRONS.items() for v in pair]), unit)


def mpp_to_ppu(mpp: Column, unit: Column) -> Column:
    return (F.lit(1.0) / mpp) * microns(unit)


def ppu_to_mpp(ppu: Column, unit: Column) -> Column:
    return F.when(ppu == 0, F.lit(0.0)).otherwise((F.lit(1.0) / ppu) * microns(unit))


def plausible_mpp(mpp: Column) -> Column:
    """False for resolutions that are likely a default or a print size."""
    ppi = (F.lit(1.0) / mpp) * 25400.0
    doubtful = ((F.lit(1.0) / mpp) * 1e3 == 1) | ((F.lit(1.0) / mpp) * 1e4 == 1) | ppi.isin(*[float(p) for p in PRINT_PPI]) | (mpp > WIDEST_MPP)
    return ~doubtful


def nearest_magnification(mpp: Column) -> Column:
    """The usual magnification nearest to 10 / mpp; of two as near, the smaller."""
    choices = F.array(*[F.struct(F.abs(F.lit(m) - F.lit(10.0) / mpp).alias("far"), F.lit(m).alias("mag")) for m in MAGNIFICATIONS])
    return F.when(mpp.isNotNull(), F.array_min(choices)["mag"])


def to_ppu(mpp: float, unit: str | int) -> float:
    return (1 / mpp) * MICRONS[str(unit)]


def to_mpp(ppu: float, unit: str | int) -> float:
    return 0.0 if ppu == 0 else (1 / ppu) * MICRONS[str(unit)]


def check_mpp(mpp: float | None) -> bool:
    if mpp is None or mpp <= 0:
        return False
    ppi = (1 / mpp) * 25400.0
    return not ((1 / mpp) * 1e3 == 1 or (1 / mpp) * 1e4 == 1 or ppi in PRINT_PPI or mpp > WIDEST_MPP)


def ngff_scale_to_mpp(scale: Column, axes: Column, units: Column) -> Column:
    """Microns per pixel of the space axes (y, x) of an NGFF scale, which is units per pixel."""
    entries = F.arrays_zip(scale.alias("s"), axes.alias("a"), units.alias("u"))
    pick = lambda name: F.element_at(F.filter(entries, lambda e: e["a"] == name), 1)
    one = lambda name: pick(name)["s"] * microns(pick(name)["u"])
    return F.struct(one("x").alias("x"), one("y").alias("y"))
