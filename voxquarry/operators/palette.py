"""Dictionary (palette) ranking, encoding, growth and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_palette(df: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` values with their canonical reference.

    Rank 0 is the most used value; equal counts order by bytes.  The window runs
    on the aggregated dictionary, never on the rows: one task orders all entries,
    which the format bounds for palettes and the caller for other dictionaries.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("uses"))
    return ranked(counts, F.desc("uses"), F.col(key)).select("ref", key, "uses")


def ranked(dictionary: DataFrame, *order) -> DataFrame:
    """A dictionary with dense references from 0 in the given order."""
    return dictionary.withColumn("ref", (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint"))


def first_seen_palette(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct ``key`` values numbered by where they first occur."""
    firsts = df.groupBy(key).agg(F.min(position).alias("first_pos"))
    return ranked(firsts, F.col("first_pos"), F.col(key)).select("ref", key, "first_pos")


def encode(df: DataFrame, palette: DataFrame, key: str) -> DataFrame:
    """Replace ``key`` by its palette reference; Catalyst broadcasts a palette that is small enough."""
    return df.join(palette.select(key, "ref"), key).drop(key)


def grow(palette: DataFrame, df: DataFrame, key: str, position: str) -> DataFrame:
    """``palette`` (ref, key) with the unknown values of ``df`` appended in first-seen order; old references stay."""
    base = palette.agg((F.coalesce(F.max("ref"), F.lit(-1)) + 1).alias("base"))
    fresh = first_seen_palette(df.join(palette, key, "left_anti"), key, position)
    moved = fresh.crossJoin(F.broadcast(base)).select((F.col("ref") + F.col("base")).alias("ref"), key)  # base is one row
    return palette.select("ref", key).unionByName(moved)


def used(palette: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Entries that something refers to."""
    return palette.join(refs.select(key), key, "left_semi")


def orphans(palette: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Entries that nothing refers to."""
    return palette.join(refs.select(key), key, "left_anti")


def with_overrides(entries: DataFrame, overrides: DataFrame, key: str, version: str, default) -> DataFrame:
    """Effective version: the override where there is one, else the file's."""
    return entries.join(overrides.select(key, version), key, "left").withColumn(version, F.coalesce(version, default))


def elect_default(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent ``value`` of each group, ties to the least; an argmax over pre-aggregated counts."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("a"), F.col(value).alias("b")))
    return counts.groupBy(*group).agg(best.alias("w")).select(*group, F.col("w.b").alias(value), (-F.col("w.a")).alias("votes"))


def _with_default(df: DataFrame, defaults: DataFrame, group: list[str], value: str) -> DataFrame:
    """``df`` with ``_default`` of each row's group; a null group is a group like any other."""
    d = defaults.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(value).alias("_default"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & df[g].eqNullSafe(d[f"_g{i}"])
    return df.join(d, same).drop(*[f"_g{i}" for i in range(len(group))])


def elide_default(df: DataFrame, defaults: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows that differ from their group's default; null is a value like any other."""
    return _with_default(df, defaults, group, value).filter(~F.col(value).eqNullSafe(F.col("_default"))).drop("_default")


def fill_default(keys: DataFrame, kept: DataFrame, defaults: DataFrame, key: list[str], group: list[str], value: str) -> DataFrame:
    """All ``keys`` with the kept value, which may be null, or else the group's default."""
    joined = keys.join(kept.select(*key, value, F.lit(True).alias("_kept")), key, "left")
    filled = F.when(F.col("_kept"), F.col(value)).otherwise(F.col("_default"))
    return _with_default(joined, defaults, group, value).withColumn(value, filled).drop("_default", "_kept")


def local_palette(values):
    """Sorted distinct entries of an array, and each element's index in them."""
    entries = F.array_sort(F.array_distinct(values))
    return entries, F.transform(values, lambda v: (F.array_position(entries, v) - 1).cast("int"))


def index_width(n):
    """Bytes of an index into a palette of n entries: 0, 1 or 2."""
    return F.when(n == 1, 0).when(n <= 256, 1).otherwise(2).cast("int")
