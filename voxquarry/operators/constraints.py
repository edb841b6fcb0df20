"""Integrity constraints: each gives (rule, key, detail) rows for what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(df: DataFrame, rule: str, key: list[str], detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws(",", *[F.col(k).cast("string") for k in key]).alias("key"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, key: list[str], rule: str = "unique") -> DataFrame:
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return _said(twice, rule, key, F.col("n"))


def references(df: DataFrame, parent: DataFrame, key: str, rule: str = "reference") -> DataFrame:
    return _said(df.join(parent.select(key), key, "left_anti"), rule, [key], F.lit("missing"))


def in_range(df: DataFrame, key: list[str], value: str, low, high, rule: str = "range") -> DataFrame:
    return _said(df.filter(~F.col(value).between(low, high)), rule, key, F.col(value))


def ascending(df: DataFrame, order: str, value: str, rule: str = "ascent", width: int = 1 << 18) -> DataFrame:
    """Rows whose value isn't greater than that of the row before in ``order``."""
    from .ordered import lagged

    before = lagged(df, order, value, "_before", F.lit(None).cast(df.schema[value].dataType), width)
    return _said(before.filter(F.col(value) <= F.col("_before")), rule, [order], F.concat_ws("<=", F.col(value).cast("string"), F.col("_before").cast("string")))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)
