"""Order-dependent operators over stretches of any width."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from voxquarry.operators import constraints, ordered


@pytest.mark.parametrize("width", [1, 7, 1 << 18])
def test_widths(spark, width):
    rng = random.Random(width)
    keys = sorted(rng.sample(range(-500, 500), 120))
    values = [rng.randint(-9, 9) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, values)), "k long, v long").repartition(3)
    get = lambda d, c: [r[c] for r in d.orderBy("k").collect()]
    assert get(ordered.running_sum(df, "k", "v", "s", width), "s") == list(accumulate(values))
    assert get(ordered.row_index(df, "k", "i", width), "i") == list(range(120))
    assert get(ordered.lagged(df, "k", "v", "p", F.lit(0).cast("bigint"), width), "p") == [0, *values[:-1]]
    known, wrong = -1, []
    for k, v in zip(keys, values):
        if v > known + 1:
            wrong.append(k)
        known = max(known, v)
    assert get(ordered.first_use_violations(df, "k", "v", width), "k") == wrong
    falls = [str(k) for k, a, b in zip(keys[1:], values, values[1:]) if b <= a]
    assert sorted(r["key"] for r in constraints.ascending(df, "k", "v", width=width).collect()) == sorted(falls)


def test_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert ordered.running_sum(df, "k", "v", "s").collect() == [] and ordered.stride_sample(df, "k", 3).collect() == []
    assert ordered.latest_wins(df, ["k"], ["v"]).collect() == []
