"""Metadata of next-generation file formats, version 0.4, as nested columns and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unit names of the format.
SPACE_UNITS = (
    "angstrom", "attometer", "centimeter", "decimeter", "exameter", "femtometer", "foot", "gigameter", "hectometer", "inch", "kilometer", "megameter", "meter", "micrometer", "mile",
    "millimeter", "nanometer", "parsec", "petameter", "picometer", "terameter", "yard", "yoctometer", "yottameter", "zeptometer", "zettameter",
)
TIME_UNITS = (
    "attosecond", "centisecond", "day", "decisecond", "exasecond", "femtosecond", "gigasecond", "hectosecond", "hour", "kilosecond", "megasecond", "microsecond", "millisecond", "minute",
    "nanosecond", "petasecond", "picosecond", "second", "terasecond", "yoctosecond", "yottasecond", "zeptosecond", "zettasecond",
)

SCHEMA = """_creator STRUCT<name: STRING, version: STRING>,
multiscales ARRAY<STRUCT<axes: ARRAY<STRUCT<name: STRING, type: STRING, unit: STRING>>,
  datasets: ARRAY<STRUCT<path: STRING, coordinateTransformations: ARRAY<STRUCT<type: STRING, scale: ARRAY<DOUBLE>>>>>, version: STRING>>,
_ARRAY_DIMENSIONS ARRAY<STRING>,
omero STRUCT<name: STRING, id: INT, channels: ARRAY<STRUCT<active: BOOLEAN, coefficient: DOUBLE, color: STRING, family: STRING, inverted: BOOLEAN, label: STRING,
  window: STRUCT<`end`: DOUBLE, `max`: DOUBLE, `min`: DOUBLE, start: DOUBLE>>>, rdefs: STRUCT<defaultT: INT, defaultZ: INT, model: STRING>, version: STRING>"""


def zattrs(levels: list[tuple[int, int]], mpp_y: Column, mpp_x: Column, name: str = "mosaiq", version: str = "0.1.0") -> Column:
    """The attributes of a pyramid of (level, downsample); identity where a resolution is null."""
    known = mpp_y.isNotNull() & mpp_x.isNotNull()

    def dataset(level: int, d: int) -> Column:
        scale = F.array((mpp_y * d).cast("double"), (mpp_x * d).cast("double"), F.lit(1.0))
        step = F.struct(F.when(known, "scale").otherwise("identity").alias("type"), F.when(known, scale).alias("scale"))
        return F.struct(F.lit(str(level)).alias("path"), F.array(step).alias("coordinateTransformations"))

    axes = F.array(*[F.struct(F.lit(a).alias("name"), F.lit("space" if a != "c" else "channel").alias("type"), (F.lit("micrometer") if a != "c" else F.lit(None).cast("string")).alias("unit")) for a in "yxc"])
    window = F.struct(F.lit(255.0).alias("end"), F.lit(255.0).alias("max"), F.lit(0.0).alias("min"), F.lit(0.0).alias("start"))
    channels = F.array(*[F.struct(F.lit(True).alias("active"), F.lit(1.0).alias("coefficient"), F.lit(color).alias("color"), F.lit("linear").alias("family"), F.lit(False).alias("inverted"), F.lit(label).alias("label"), window.alias("window")) for label, color in (("Red", "FF0000"), ("Green", "00FF00"), ("Blue", "0000FF"))])
    return F.struct(
        F.struct(F.lit(name).alias("name"), F.lit(version).alias("version")).alias("_creator"),
        F.array(F.struct(axes.alias("axes"), F.array(*[dataset(*x) for x in levels]).alias("datasets"), F.lit("0.4").alias("version"))).alias("multiscales"),
        F.array(*[F.lit(a) for a in "yxc"]).alias("_ARRAY_DIMENSIONS"),
        F.struct(F.lit("image").alias("name"), F.lit(1).alias("id"), channels.alias("channels"), F.struct(F.lit(0).alias("defaultT"), F.lit(0).alias("defaultZ"), F.lit("color").alias("model")).alias("rdefs"), F.lit("0.4").alias("version")).alias("omero"),
    )


def zattrs_json(levels: list[tuple[int, int]], mpp_y: Column, mpp_x: Column) -> Column:
    return F.to_json(zattrs(levels, mpp_y, mpp_x), {"ignoreNullFields": "true"})


def parse_zattrs(text: Column) -> Column:
    return F.from_json(text, SCHEMA)
