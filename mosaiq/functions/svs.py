"""Descriptions of scanned slides: ``key = value`` pairs joined by pipes after a header line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build_description(header: Column, values: dict[str, Column]) -> Column:
    """Header, then the pairs whose value is not null."""
    return F.concat_ws("|", header, *[F.when(v.isNotNull(), F.concat(F.lit(f"{k} = "), v.cast("string"))) for k, v in values.items()])


def parse_description(description: Column) -> Column:
    """Map of the pairs in the last line; pieces without ``=`` are left out, and of a repeated key the last counts."""
    pieces = F.filter(F.split(F.substring_index(description, "\n", -1), r"\|"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(F.split(p, "=")[0]).alias("k"), F.trim(F.split(p, "=")[1]).alias("v")))
    later = lambda i: F.slice(pairs, i + 2, F.size(pairs))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(later(i), lambda q: q["k"] == p["k"])))


def description_mpp(pairs: Column) -> Column:
    """Microns per pixel of both axes, null if the description has none."""
    mpp = F.try_element_at(pairs, F.lit("MPP")).try_cast("double")
    return F.when(mpp.isNotNull(), F.struct(mpp.alias("x"), mpp.alias("y")))
