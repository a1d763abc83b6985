"""Selections and renames of paths, as predicates and columns that compose and push down."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: * crosses folders, ? is one letter."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches(path: Column, pattern: str) -> Column:
    """A pattern with wildcards matches the whole path, one without matches a part."""
    if "*" in pattern or "?" in pattern:
        return path.rlike(glob_regex(pattern))
    return path.contains(pattern)


def only(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(path, p) for p in patterns), F.lit(not patterns))


def without(path: Column, patterns: list[str]) -> Column:
    return ~reduce(lambda a, b: a | b, (matches(path, p) for p in patterns), F.lit(False))


def size_between(size: Column, least: int | None = None, most: int | None = None) -> Column:
    out = F.lit(True)
    if least is not None:
        out = out & (size >= least)
    return out & (size <= most) if most is not None else out


def date_between(ts: Column, least: str | None = None, most: str | None = None) -> Column:
    out = F.lit(True)
    if least is not None:
        out = out & (ts >= F.lit(least).cast("timestamp_ntz"))
    return out & (ts <= F.lit(most).cast("timestamp_ntz")) if most is not None else out


def direct_children(path: Column, folder: str) -> Column:
    """Whether a path lies in a folder itself, not below it."""
    rest = F.substring(path, F.lit(len(folder) + 2), F.length(path))
    return path.startswith(f"{folder}/") & (F.size(F.split(rest, "/")) == 1)


#: Names that the canned exclusion lists leave out.
EXCLUSIONS = {
    "mac": ["*/.DS_Store", "*/._*", "*/.Spotlight-V100/*", "*/.Trashes/*"],
    "nas": ["*/@eaDir/*", "*/#recycle/*"],
    "windows": ["*/Thumbs.db", "*/System Volume Information/*", "*/$RECYCLE.BIN/*"],
}


def excluding(files: DataFrame, lists: list[str]) -> DataFrame:
    """files without those that a canned list names."""
    patterns = [p for name in lists for p in EXCLUSIONS[name]]
    return files.where(without(F.concat(F.lit("/"), F.col("path")), patterns))


def renamed(path: Column, find: str | None = None, replace: str = "", to: str | None = None, flat: bool = False) -> Column:
    """A path with a text replaced, its folders dropped and a destination in front."""
    if find is not None:
        path = F.replace(path, F.lit(find), F.lit(replace))
    if flat:
        path = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.lit(f"{to}/"), path) if to is not None else path


def coded(path: Column) -> Column:
    """A flat name without marks that file systems refuse."""
    return F.translate(F.base64(path.cast("binary")), "+/=", "-_")


#: Names and characters that some file systems reserve.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]


def safe(name: Column, length: int = 255) -> Column:
    """A file name without reserved characters and names, of bounded length."""
    clean = F.regexp_replace(name, r'[<>:"\\|?*\x00-\x1f]', "_")
    stem = F.lower(F.substring_index(clean, ".", 1))
    return F.substring(F.when(stem.isin(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean), 1, length)


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def size_of(text: Column) -> Column:
    """Bytes of a human size: 64K, 500MB, 1G, powers of 1024; null if it is none."""
    number = F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMGTkmgt]?)[Bb]?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMGTkmgt]?)[Bb]?\s*$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1).cast("long")
    return F.when(number != "", number.cast("long") * factor)


def parse_rules(spec: str) -> list[tuple[str, list[tuple[int | None, str]]]]:
    """``text:5/20MB:7;*:8``: for each group the levels by size, the first step from 0."""
    units = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
    out = []
    for rule in filter(None, spec.split(";")):
        group, first, *steps = re.split(r":|/", rule)
        levels: list[tuple[int | None, str]] = [(0, first)]
        for size, level in zip(steps[::2], steps[1::2], strict=True):
            number, unit = re.fullmatch(r"([0-9]+)([KMG]?)B?", size.upper()).groups()
            levels.append((int(number) * units[unit], level))
        out.append((group, levels))
    return out


def routed(kind: Column, size: Column, spec: str) -> Column:
    """The level of the first rule whose group is the kind or *, by size step; a CASE that Catalyst folds."""
    out = F.lit(None).cast("string")
    for group, levels in reversed(parse_rules(spec)):
        level = F.lit(levels[0][1])
        for least, name in levels[1:]:
            level = F.when(size >= least, name).otherwise(level)
        out = level if group == "*" else F.when(kind == group, level).otherwise(out)
    return out


def case_collisions(files: DataFrame) -> DataFrame:
    """path and target: names that differ by case alone get numbered suffixes, in order of path. Single names skip the window."""
    from pyspark.sql import Window

    lower = files.select("path", F.lower("path").alias("low"))
    crowded = lower.groupBy("low").count().where("count > 1").select("low")
    place = F.row_number().over(Window.partitionBy("low").orderBy("path")) - 1
    many = lower.join(crowded, "low", "left_semi").withColumn("place", place)
    suffix = F.when(F.col("place") > 0, F.concat(F.col("path"), F.lit("_"), F.lpad(F.col("place").cast("string"), 8, "0"))).otherwise(F.col("path"))
    return many.select("path", suffix.alias("target")).unionByName(lower.join(crowded, "low", "left_anti").select("path", F.col("path").alias("target")))
