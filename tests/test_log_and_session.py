"""Versioned tables, sessions and streams."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from worlds import world

from voxquarry.codec.limits import InvalidContent
from voxquarry.codec.solid import content_hash, publish, read_world, write_world
from voxquarry.functions import binary
from voxquarry.operators import log, zorder
from voxquarry.operators.log import VersionedTable
from voxquarry.plans.session import Options, Session
from voxquarry.streaming import log_stream


def rows(spark, *values):
    return spark.createDataFrame(list(values), "x int, z int, v string")


def content(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), ["x", "z"], rows(spark, (0, 0, "a"), (1, 0, "b"), (2, 0, "c")))
    assert t.checkpoint() is None
    t.upsert(rows(spark, (1, 0, "B"), (3, 0, "d")))
    t.delete(rows(spark, (2, 0, "")))
    assert content(t.read()) == [(0, 0, "a"), (1, 0, "b"), (2, 0, "c")]
    t.set_meta({"name": "w"})
    assert t.checkpoint() == 2
    now = [(0, 0, "a"), (1, 0, "B"), (3, 0, "d")]
    assert content(t.read()) == now and content(t.read(1)) == [(0, 0, "a"), (1, 0, "b"), (2, 0, "c")]
    t.snapshot("s")
    side = t.fork("side")
    side.upsert(rows(spark, (9, 9, "side")))
    side.checkpoint()
    t.upsert(rows(spark, (2, 0, "again")))
    t.set_meta({"name": "other"})
    t.checkpoint()
    assert (9, 9, "side") not in content(t.read()) and (2, 0, "again") not in content(side.read())
    before = content(t.read())
    assert t.garbage_ratio() > 0.3
    t.compact(lambda df: zorder.cluster(df, "x", "z"))
    assert content(t.read()) == before and t.garbage_ratio() == 0
    t.rollback("s")
    assert content(t.read()) == now and t.meta() == {"name": "w"} and t.snapshots() == ["s"]
    t.delete_snapshot("s")
    assert t.snapshots() == []
    for name in ("", "..", "a/b"):
        with pytest.raises(InvalidContent):
            t.snapshot(name)
    with pytest.raises(InvalidContent):
        VersionedTable(spark, str(tmp_path / "t"), ["x", "z"], read_only=True).upsert(rows(spark))
    t.close()


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    VersionedTable.create(spark, path, ["x", "z"], rows(spark, (0, 0, "a")))

    def write(i):
        t = VersionedTable(spark, path, ["x", "z"])
        for j in range(3):
            t.upsert(rows(spark, (i, j + 1, "w")))
            t.checkpoint()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    t = VersionedTable(spark, path, ["x", "z"])
    assert t.versions() == list(range(1, 14))
    assert content(t.read()) == sorted([(0, 0, "a")] + [(i, j + 1, "w") for i in range(4) for j in range(3)])
    assert not [f for f in os.listdir(f"{path}/_log/main") if not f.endswith(".json")]
    with pytest.raises(InvalidContent):
        VersionedTable.create(spark, path, ["x", "z"], rows(spark, (0, 0, "a")))


def test_a_version_taken_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = VersionedTable.create(spark, path, ["x", "z"], rows(spark, (0, 0, "a")))
    other = VersionedTable(spark, path, ["x", "z"])
    other.upsert(rows(spark, (1, 0, "other")))
    other.checkpoint()
    real, stale = t.versions, []
    monkeypatch.setattr(t, "versions", lambda: stale.pop() if stale else real())
    for claim in (t._linked, t._renamed):
        monkeypatch.setattr(t, "_linked", claim)
        stale.append(real()[:-1])  # as if the newest version came after the look at the folder
        t.upsert(rows(spark, (2, 0, claim.__name__)))
        t.checkpoint()
        assert content(t.read()) == [(0, 0, "a"), (1, 0, "other"), (2, 0, claim.__name__)]
    assert not [f for f in os.listdir(f"{path}/_log/main") if not f.endswith(".json")]


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    path = str(tmp_path / "t")
    t = VersionedTable.create(spark, path, ["x", "z"], rows(spark, (0, 0, "a"), (1, 0, "b")))
    t.delete(rows(spark, (1, 0, "")))
    t.checkpoint()
    other = VersionedTable(spark, path, ["x", "z"])

    def meanwhile(live):
        other.upsert(rows(spark, (5, 0, "late")))
        other.checkpoint()
        return live

    t.compact(meanwhile)
    assert content(t.read()) == [(0, 0, "a"), (5, 0, "late")] and t._load()["changes"]
    with pytest.raises(InvalidContent):
        t.compact(lambda live: (other.compact(), live)[1])
    assert content(t.read()) == [(0, 0, "a"), (5, 0, "late")]


def test_folded_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FOLD", 3)
    t = VersionedTable.create(spark, str(tmp_path / "t"), ["x", "z"], rows(spark, (0, 0, "a"), (1, 0, "b")))
    for i in range(4):
        t.upsert(rows(spark, (i, 0, f"v{i}"), (9, 9, f"v{i}")))
        t.delete(rows(spark, (i - 1, 0, "")))
        t.checkpoint()
        assert len(t._load()["changes"]) <= 3
    assert content(t.read()) == [(3, 0, "v3"), (9, 9, "v3")]
    assert content(t.read(2)) == [(0, 0, "v0"), (1, 0, "b"), (9, 9, "v0")]


def test_stream(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), ["x", "z"], rows(spark, (0, 0, "a")))
    source = str(tmp_path / "in")
    schema = "x int, z int, v string, seq long, _deleted boolean"
    spark.createDataFrame([(0, 0, "new", 1, False), (0, 0, "newer", 2, False), (5, 5, "p", 1, False)], schema).write.parquet(source)
    run = lambda: log_stream.start(spark.readStream.schema(schema).parquet(source), t, ["seq"], str(tmp_path / "ck")).awaitTermination()
    run()
    assert content(t.read()) == [(0, 0, "newer"), (5, 5, "p")]
    spark.createDataFrame([(5, 5, None, 9, True)], schema).write.mode("append").parquet(source)
    run()
    assert content(t.read()) == [(0, 0, "newer")]
    log_stream.apply_batch(t, spark.createDataFrame([(7, 7, "twice", 1, False)], schema), ["seq"], "main", 0)
    assert content(t.read()) == [(0, 0, "newer")]


def test_session(spark, tmp_path):
    w = world(4)
    publish(str(tmp_path / "overworld.w"), write_world(w))
    path = str(tmp_path / "overworld.w")
    s = Session.open(spark, path, Options(filter_column="x >= 0", filter_block_entity="get_json_object(nbt_json, '$.id') <> 'Chest'", skip={"entities"}))
    assert s.table("columns").count() == 2 and s.merged("columns").count() == 4
    assert s.table("block_entities").count() == 0 and s.table("entities").count() == 0
    other = s.instance()
    changed = s.merged("columns").filter("x = -2 AND z = -1").withColumn("tick", F.lit(5).cast("bigint"))
    s.upsert("columns", changed)
    assert s.merged("columns").filter("tick = 5").count() == 1 and other.merged("columns").filter("tick = 5").count() == 0
    (saved,) = other.save_as(str(tmp_path / "out")).collect()
    assert saved["content_hash"] == content_hash(w)
    s.remove("columns", s.merged("columns").filter("x = 1"))
    (saved,) = s.save_as(str(tmp_path / "out2")).collect()
    back = read_world(open(saved["path"], "rb").read())
    assert len(back.columns) == 3 and {c.tick for c in back.columns} == {5, 77}
    with pytest.raises(InvalidContent):
        Session.open(spark, path, Options(read_only=True)).upsert("columns", changed)
    assert Session.empty(spark).table("columns").count() == 0
    with pytest.raises(ValueError):
        Options(skip={"columns"})


def test_binary_functions(spark):
    df = spark.createDataFrame([(b"abc", 300, "t")], "b binary, n long, s string")
    made = df.select(
        binary.xxh64_hex("b").alias("h"), binary.uvarint("n").alias("u"), binary.svarint("n").alias("z"),
        binary.nbt_pair(F.lit("key"), "n", "s").alias("nbt"), binary.nbt_error("b").alias("e"),
    )
    row = made.withColumn("json", binary.nbt_to_json("nbt")).withColumn("back", binary.from_uvarint("u")).first()
    assert row["h"] == "44bc2cf5ad770999" and bytes(row["u"]) == b"\xac\x02" and bytes(row["z"]) == b"\xd8\x04"
    assert row["json"] == '{"k": 300, "key": "t"}' and row["back"] == 300 and row["e"].startswith("Corrupt")
