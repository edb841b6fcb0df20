"""Null keys and values, sparse keys, hidden and removed columns, worlds of one name."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from worlds import world

from voxquarry.codec.indexed import train_dictionary
from voxquarry.codec.solid import publish, read_world, write_world
from voxquarry.operators import ordered, palette
from voxquarry.plans.session import Options, Session

def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(None, 5), (3, 1), (1, 2)], "k long, v long")
    got = lambda d, c: [r[c] for r in d.orderBy(F.col("k").asc_nulls_first()).collect()]
    assert got(ordered.running_sum(df, "k", "v", "s"), "s") == [5, 7, 8]
    assert got(ordered.row_index(df, "k", "i"), "i") == [0, 1, 2]
    assert got(ordered.lagged(df, "k", "v", "p", F.lit(0).cast("bigint")), "p") == [0, 5, 2]
    assert got(ordered.delta_encode(df, "k", "v", "d"), "d") == [5, -3, -1]
    assert [r["v"] for r in ordered.first_use_violations(df, "k", "v").collect()] == [5]


def test_null_values(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, None), (4, 4)], "k long, v long")
    got = lambda d, c: [r[c] for r in d.orderBy("k").collect()]
    for width in (1, 2, 100):
        assert got(ordered.running_sum(df, "k", "v", "s", width), "s") == [None, 3, 3, 7]
        assert got(ordered.lagged(df, "k", "v", "p", F.lit(0).cast("bigint"), width), "p") == [0, None, 3, None]


def test_sparse_keys(spark):
    rng = random.Random(4)
    keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(300)})
    values = [rng.randint(-9, 9) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, values)), "k long, v long").repartition(3)
    got = lambda d, c: [r[c] for r in d.orderBy("k").collect()]
    assert got(ordered.running_sum(df, "k", "v", "s"), "s") == list(accumulate(values))
    assert got(ordered.lagged(df, "k", "v", "p", F.lit(0).cast("bigint")), "p") == [0, *values[:-1]]


def test_null_is_no_default(spark):
    rows = [("g", 1, "x"), ("g", 2, "y"), ("g", 3, None), (None, 4, "x"), (None, 5, "z")]
    df = spark.createDataFrame(rows, "g string, k long, v string")
    defaults = spark.createDataFrame([("g", "x"), (None, "z")], "g string, v string")
    kept = palette.elide_default(df, defaults, ["g"], "v")
    assert sorted(r["k"] for r in kept.collect()) == [2, 3, 4]
    back = palette.fill_default(df.select("g", "k"), kept, defaults, ["k"], ["g"], "v")
    assert sorted((r["k"], r["v"]) for r in back.select("k", F.coalesce("v", F.lit("-")).alias("v")).collect()) == [(k, v or "-") for _, k, v in rows]


PARTS = ("columns", "sections", "biome_sections", "entities", "block_entities", "scheduled_updates")


def opened(spark, tmp_path, options=None):
    publish(str(tmp_path / "overworld.w"), write_world(world(4)))
    return Session.open(spark, str(tmp_path / "overworld.w"), options)


def test_hidden_columns_hide_all_their_parts(spark, tmp_path):
    whole, some = opened(spark, tmp_path), opened(spark, tmp_path, Options(filter_column="x >= 0"))
    for name in PARTS:
        assert 2 * some.table(name).count() == whole.table(name).count() == some.merged(name).count(), name


def test_removed_columns_take_all_their_parts(spark, tmp_path):
    s = opened(spark, tmp_path)
    before = {n: s.table(n).count() for n in PARTS}
    gone = s.merged("columns").filter("x = 1")
    column = {n: s.merged(n) for n in PARTS}
    s.remove("columns", gone)
    assert {n: s.table(n).count() * 4 for n in PARTS} == {n: 3 * c for n, c in before.items()}
    s.put_if_absent({n: df.filter("x = 1") if "x" in df.columns and n in PARTS[:3] else df for n, df in column.items()})
    assert {n: s.table(n).count() for n in PARTS} == before


def test_load_generates_what_is_missing_once(spark, tmp_path):
    s = opened(spark, tmp_path)
    asked = []

    def generate(keys):
        asked.append(sorted((r["x"], r["z"]) for r in keys.collect()))
        template = s.merged("columns").filter("x = 0").drop("x", "z")
        sections = s.merged("sections").filter("x = 0").drop("x", "z")
        at = keys.select("world_id", "x", "z")
        put = lambda part, names: at.join(part, "world_id").select(*names)
        return {"columns": put(template, s.merged("columns").columns), "sections": put(sections, s.merged("sections").columns)}

    name = s.merged("columns").first()["world_id"]
    keys = spark.createDataFrame([(name, 1, -1), (name, 9, 9)], "world_id string, x int, z int")
    assert not s.exists(name, 9, 9) and s.exists(name, 1, -1)
    n = s.table("sections").filter("x = 0").count()
    assert s.load(keys, generate).filter("x = 9").count() == n and s.exists(name, 9, 9)
    assert s.load(keys, generate).filter("x = 9").count() == n
    assert asked == [[(9, 9)], []]
    assert all(r["populated"] for r in s.populated().collect()) and s.populated().count() == 5


def test_save_and_go_on_as_an_indexed_world(spark, tmp_path):
    s = opened(spark, tmp_path)
    s.upsert("columns", s.merged("columns").filter("x = 1").withColumn("tick", F.lit(5).cast("bigint")))
    after = s.save(str(tmp_path / "out"), mode="indexed")
    assert after.table("worlds").first()["mode"] == "indexed" and not after.changes
    assert after.table("columns").filter("tick = 5").count() == 1 and after.table("columns").count() == 4


def test_worlds_of_one_name_stay_apart(spark, tmp_path):
    for folder, n in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        publish(str(tmp_path / folder / "overworld.w"), write_world(world(n)))
    publish(str(tmp_path / "nether.w"), write_world(world(3)))
    s = Session.open(spark, f"{tmp_path}/a,{tmp_path}/b,{tmp_path}/nether.w")
    saved = s.save_as(str(tmp_path / "out")).collect()
    assert len({r["path"] for r in saved}) == 3
    assert sorted(len(read_world(open(r["path"], "rb").read()).columns) for r in saved) == [1, 2, 3]
    assert [r["path"].endswith("/nether.world") for r in saved].count(True) == 1


def test_dictionary_samples_all_of_a_world():
    rng = random.Random(8)
    small = [(" ".join(rng.choice(["stone", "dirt", "water", "lava"]) + str(rng.randrange(9)) for _ in range(150))).encode() for _ in range(200)]
    assert train_dictionary(small) is not None
    assert train_dictionary([rng.randbytes(9 << 20), *small]) is not None
