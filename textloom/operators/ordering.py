"""Orders over file listings and the newest among them. A listing has path, size, mod_time and dir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = {"size": "size", "path": "path", "name": "path"}
_WAYS = {"asc": True, "ascending": True, "desc": False, "descending": False}


def sort_columns(spec: str | None, seed: int = 0) -> list[Column]:
    """Columns for a sort specification: none, shuffle, size_*, path_* or name_*, each ascending or descending, short or long.

    Ties are broken by path, so the order is the same in every run; nulls come last.
    """
    spec = (spec or "none").lower()
    if spec in ("none", ""):
        return []
    if spec in ("shuffle", "random"):
        return [F.xxhash64(F.lit(seed), F.col("path")), F.col("path")]
    name, _, way = spec.partition("_")
    if name not in _NAMES or way not in _WAYS:
        raise ValueError(f"unknown sort specification {spec!r}")
    c = F.col(_NAMES[name])
    first = c.asc_nulls_last() if _WAYS[way] else c.desc_nulls_last()
    return [first] if name != "size" else [first, F.col("path").asc()]


def sort_files(files: DataFrame, spec: str | None, seed: int = 0) -> DataFrame:
    columns = sort_columns(spec, seed)
    return files.orderBy(*columns) if columns else files


def newest(files: DataFrame, suffixes: tuple[str, ...] | None = None, directories: bool | None = False) -> DataFrame:
    """One row: the path modified last, ties by path; no row for an empty listing.

    ``directories``: False for files, True for directories, None for both.
    """
    held = files.where("mod_time is not null")
    if directories is not None:
        held = held.where(F.col("dir") == directories)
    if suffixes:
        held = held.where(" or ".join(f"endswith(path, '{s}')" for s in suffixes))
    top = held.agg(F.max(F.struct("mod_time", "path")).alias("m"))
    return top.where("m is not null").select(F.col("m.path").alias("path"), F.col("m.mod_time").alias("mod_time"))


def up_to_date(inputs: DataFrame, outputs: DataFrame) -> bool:
    """Whether the oldest output is newer than the newest input; without outputs it is not."""
    last = inputs.agg(F.max("mod_time")).first()[0]
    first = outputs.agg(F.min("mod_time")).first()[0]
    return first is not None and (last is None or first > last)
