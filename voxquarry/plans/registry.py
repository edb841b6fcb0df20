"""Registered queries of the voxel engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Decorator: adds a query, and its SQL counterpart where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register(
    "palette_rank",
    """
    SELECT CAST(row_number() OVER (ORDER BY uses DESC, state) - 1 AS BIGINT) AS ref, state, uses
    FROM (SELECT l_returnflag || '|' || l_linestatus AS state, count(*) AS uses FROM lineitem GROUP BY 1)
    """,
)
def palette_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxquarry.operators.palette import canonical_palette

    items = table(spark, sf_dir, "lineitem")
    return canonical_palette(items.select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("state")), "state")
