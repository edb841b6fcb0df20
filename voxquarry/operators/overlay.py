"""Base tables with overlays: upsert, delete, precedence lookup, branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(base: DataFrame, overlay: DataFrame, key: list[str]) -> DataFrame:
    """Union of both; rows of the overlay replace the base's rows of their key."""
    return base.join(overlay.select(*key), key, "left_anti").unionByName(overlay.select(*base.columns))


def delete(base: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    return base.join(tombstones.select(*key), key, "left_anti")


def apply_log(base: DataFrame, changes: DataFrame, key: list[str], order: list[str], deleted: str) -> DataFrame:
    """Apply a change log (upserts, and deletions where ``deleted``): the last change of a key wins."""
    from .ordered import latest_wins

    last = latest_wins(changes, key, order)
    return delete(base, last, key).unionByName(last.filter(~F.col(deleted)).select(*base.columns))


def precedence_lookup(keys: DataFrame, sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """Value of the first source that has the key."""
    joined = reduce(lambda d, s: d.join(s[1].select(*key, F.col(value).alias(f"_v{s[0]}")), key, "left"), enumerate(sources), keys)
    return joined.select(*keys.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))]).alias(value))
