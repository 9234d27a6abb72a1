"""File types by signature: rules as data, applied as column expressions over binary headers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_BYTES = 1024


@dataclass(frozen=True)
class Sign:
    """Bytes at an offset (anywhere if None), or a pattern at the start (anywhere if None)."""

    bytes_: bytes = b""
    at: int | None = 0
    pattern: str | None = None

    def column(self, header: Column) -> Column:
        if self.pattern is not None:
            anchor = "(?s)" if self.at is None else "(?s)^"
            return F.decode(header, "ISO-8859-1").rlike(anchor + self.pattern)
        sought = F.unhex(F.lit(self.bytes_.hex()))
        if self.at is None:
            return F.contains(header, sought)
        return F.substring(header, self.at + 1, len(self.bytes_)) == sought

    def holds(self, header: bytes) -> bool:
        if self.pattern is not None:
            found = re.compile(self.pattern.encode("latin1"), re.S)
            return bool(found.search(header) if self.at is None else found.match(header))
        return self.bytes_ in header if self.at is None else header[self.at : self.at + len(self.bytes_)] == self.bytes_


#: Type -> signs in conjunctive form: all of the tuples, any sign of each.
# Signatures of the formats.
RULES: dict[tuple[str, ...], tuple[tuple[Sign, ...], ...]] = {
    ("tiff",): ((Sign(b"II\x2a\x00"), Sign(b"II\x2b\x00"), Sign(b"MM\x00\x2a"), Sign(b"MM\x00\x2b")),),
    ("jpeg",): ((Sign(b"\xff\xd8"),),),
    ("png",): ((Sign(b"\x89PNG\r\n\x1a\n"),),),
    ("jp2",): ((Sign(b"\x00\x00\x00\x0cjP  \r\n\x87\n"),),),
    ("webp",): ((Sign(pattern="RIFF....WEBP"),),),
    ("dcm",): ((Sign(b"DICM", 128),),),
    ("zip",): ((Sign(b"PK\x03\x04"),),),
    ("sqlite3",): ((Sign(b"SQLite format 3\x00"),),),
    ("tiff", "svs"): ((Sign(b"Aperio", None),),),
    ("jp2", "omnyx"): ((Sign(pattern=r"(?i)<description>\s*Omnyx", at=None),),),
}


def rule_column(rule: tuple[tuple[Sign, ...], ...], header: Column) -> Column:
    """The rule over a binary column: a conjunction of disjunctions."""
    whole = F.lit(True)
    for choices in rule:
        some = F.lit(False)
        for sign in choices:
            some = some | sign.column(header)
        whole = whole & some
    return whole


def file_types(content: Column, header_bytes: int | None = HEADER_BYTES, rules: dict = RULES) -> Column:
    """All matching types, ``array<array<string>>``, shorter ones first; a subtype needs its parent."""
    header = F.substring(content, 1, header_bytes) if header_bytes else content
    matched = {}
    for kind in sorted(rules, key=len):
        holds = rule_column(rules[kind], header)
        matched[kind] = holds if len(kind) == 1 else matched[kind[:-1]] & holds
    return F.array_compact(F.array(*[F.when(c, F.array(*[F.lit(k) for k in kind])) for kind, c in matched.items()]))


def types_of(header: bytes, rules: dict = RULES) -> list[tuple[str, ...]]:
    """The same for one header on the driver."""
    found: list[tuple[str, ...]] = []
    for kind in sorted(rules, key=len):
        if (len(kind) == 1 or kind[:-1] in found) and all(any(s.holds(header) for s in choices) for choices in rules[kind]):
            found.append(kind)
    return found


def type_names(types: Column) -> Column:
    return F.transform(types, lambda t: F.array_join(t, "/"))


def directory_types(files: DataFrame) -> DataFrame:
    """dir and types of directories, from their files' dir, name and header (binary)."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = files.groupBy("dir").agg(has(F.col("name") == ".zgroup").alias("grp"), has(F.col("name") == ".zarray").alias("arr"), has(F.substring("header", 129, 4) == F.unhex(F.lit(b"DICM".hex()))).alias("dcm"))
    kinds = lambda *ts: F.array(*[F.array(*[F.lit(x) for x in t]) for t in ts])
    none = F.array().cast("array<array<string>>")
    picked = F.when(F.col("grp"), kinds(("zarr",), ("zarr", "group"))).when(F.col("arr"), kinds(("zarr",), ("zarr", "array"))).when(F.col("dcm"), kinds(("dicom",))).otherwise(none)
    return seen.select("dir", picked.alias("types"))
