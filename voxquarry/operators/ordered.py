"""Order-dependent computations without a window over the whole table.

Rows are cut into stretches of the order key (``key div width``); windows run
inside a stretch, and a table with one row per stretch carries totals or last
values over.  That table is cut into stretches of its own (``FAR`` of the first
ones), so however sparse 64-bit keys are, no window holds more than 2**24 rows.
Keys are integers; ``width`` bounds the rows of a stretch where keys are unique.
Rows with a null key come first, in no particular order among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1 << 18
FAR = 1 << 22


def _stretched(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.withColumn("_stretch", F.expr(f"{key} div {width}"))


def _matched(rows: DataFrame, carried: DataFrame, on: str) -> DataFrame:
    """Join on equal values, null being one of them; ``carried`` has a row for each."""
    other = carried.withColumnRenamed(on, "_on")
    return rows.join(other, rows[on].eqNullSafe(other["_on"])).drop("_on")


def _carry(totals: DataFrame, combine, both) -> DataFrame:
    """(_stretch, _carry): the ``combine``d totals (_stretch, _total) of all stretches before; ``both`` joins two levels."""
    t = totals.withColumn("_far", F.expr(f"_stretch div {FAR}"))
    far = t.groupBy("_far").agg(combine("_total", "_stretch").alias("_total"))
    earlier = combine("_total", "_far").over(W.orderBy("_far").rowsBetween(W.unboundedPreceding, -1))
    near = combine("_total", "_stretch").over(W.partitionBy("_far").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    joined = _matched(t.withColumn("_near", near), far.select("_far", earlier.alias("_earlier")), "_far")
    return joined.select("_stretch", both(F.col("_near"), F.col("_earlier")).alias("_carry"))


def _plus(a: Column, b: Column) -> Column:
    """Sum of what isn't null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def running_sum(df: DataFrame, key: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """Sum of ``value`` over all rows up to this one in ``key`` order."""
    d = _stretched(df, key, width)
    totals = d.groupBy("_stretch").agg(F.sum(value).alias("_total"))
    carried = _carry(totals, lambda v, _: F.sum(v), _plus)
    inside = F.sum(value).over(W.partitionBy("_stretch").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    return _matched(d.withColumn(out, inside), carried, "_stretch").withColumn(out, _plus(F.col(out), F.col("_carry"))).drop("_stretch", "_carry")


def row_index(df: DataFrame, key: str, out: str, width: int = WIDTH) -> DataFrame:
    """Position from 0 in ``key`` order."""
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), key, "_one", out, width)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


def lagged(df: DataFrame, key: str, value: str, out: str, default: Column, width: int = WIDTH) -> DataFrame:
    """``value`` of the row before in ``key`` order, ``default`` for the first."""
    d = _stretched(df, key, width)
    last = lambda v, by: F.max_by(v, F.struct(by))
    lasts = d.groupBy("_stretch").agg(last(F.struct(F.col(value).alias("v")), key).alias("_total"))
    carried = _carry(lasts, last, F.coalesce)
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(W.partitionBy("_stretch").orderBy(key))
    before = F.coalesce("_lag", "_carry")
    with_lag = _matched(d.withColumn("_lag", inside), carried, "_stretch")
    return with_lag.withColumn(out, F.when(before.isNull(), default).otherwise(before["v"])).drop("_stretch", "_lag", "_carry")


def delta_encode(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Difference to the row before; the first row differs from 0."""
    return lagged(df, key, value, "_prev", F.lit(0).cast("bigint")).withColumn(out, F.col(value) - F.col("_prev")).drop("_prev")


def delta_decode(df: DataFrame, key: str, delta: str, out: str) -> DataFrame:
    return running_sum(df, key, delta, out)


def latest_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(last).select(*key, "_row.*")


def stride_sample(df: DataFrame, key: str, stride: int) -> DataFrame:
    """Every stride-th row in ``key`` order, from the first."""
    return row_index(df, key, "_index").filter(F.col("_index") % stride == 0).drop("_index")


def first_use_ids(df: DataFrame, content: str, position: str) -> DataFrame:
    """Distinct contents numbered in first-use order."""
    firsts = df.groupBy(content).agg(F.min(position).alias("first_pos"))
    return row_index(firsts, "first_pos", "blob_id")


def first_use_violations(df: DataFrame, key: str, ident: str, width: int = WIDTH) -> DataFrame:
    """Rows whose id is neither known nor the next: more than the largest id before it plus one."""
    d = _stretched(df, key, width)
    peaks = d.groupBy("_stretch").agg(F.max(ident).alias("_total"))
    carried = _carry(peaks, lambda v, _: F.max(v), F.greatest)
    inside = F.max(ident).over(W.partitionBy("_stretch").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    known = F.coalesce(F.greatest("_inside", "_carry"), F.lit(-1))
    joined = _matched(d.withColumn("_inside", inside), carried, "_stretch")
    return joined.withColumn("known_max", known.cast("bigint")).filter(F.col(ident) > F.col("known_max") + 1).drop("_stretch", "_inside", "_carry")


def trim_trailing(df: DataFrame, group: list[str], position: str, keeps) -> DataFrame:
    """Drop a group's rows after the last one that ``keeps`` holds for; inner ones stay."""
    last = df.filter(keeps).groupBy(*group).agg(F.max(position).alias("_last"))
    return df.join(last, group).filter(F.col(position) <= F.col("_last")).drop("_last")
