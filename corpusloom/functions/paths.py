"""Column functions on Windows-style paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The parts after the drive, empties dropped."""
    return F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"[\\/]"), lambda p: p != "")


def directories(path: Column) -> Column:
    """All components but the last."""
    parts = components(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def trimmed(path: Column) -> Column:
    """Without a trailing separator; a drive root keeps its colon only."""
    return F.regexp_replace(path, r"[\\/]+$", "")


def ancestors(path_key: Column) -> Column:
    """The path itself and every folder above it, so that subtree tests are equi-joins."""
    parts = F.split(path_key, r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "\\"))


def within(path_key: Column, prefix: str) -> Column:
    """Is the path the prefix or below it? (Both lower case; a bare drive takes all below it.)"""
    prefix = prefix.lower().rstrip("\\")
    if len(prefix) == 2 and prefix[1] == ":":
        return F.startswith(path_key, F.lit(prefix))
    return (path_key == prefix) | F.startswith(path_key, F.lit(prefix + "\\"))


def within_any(path_key: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | within(path_key, prefix)
    return out


def dotted_extension(extension: Column, name: Column) -> Column:
    """Lower case with a leading dot; from the name where the extension is blank."""
    own = F.when(F.trim(extension) != "", extension).otherwise(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when((own == "") | own.isNull(), F.lit("")).when(F.startswith(own, F.lit(".")), F.lower(own)).otherwise(F.concat(F.lit("."), F.lower(own)))
