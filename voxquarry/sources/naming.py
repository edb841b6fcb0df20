"""Dimensions by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the first dimensions' files.
NAMES = ("overworld", "nether", "end")


def dimension(path: Column) -> Column:
    """Number of the dimension that a world file holds, by its name without extension; null for other names."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    out = F.regexp_extract(stem, r"^dim(-?\d+)$", 1).try_cast("int")
    for number, name in enumerate(NAMES):
        out = F.when(stem == name, F.lit(number)).otherwise(out)
    return out


def file_name(dim: int, extension: str) -> str:
    return f"{NAMES[dim] if 0 <= dim < len(NAMES) else f'dim{dim}'}.{extension}"
