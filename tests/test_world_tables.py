"""Worlds as tables and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from worlds import MINIMAL, VERSION, world

from voxquarry.codec.indexed import write_indexed
from voxquarry.codec.model import Storage, Structure, state
from voxquarry.codec.solid import content_hash, publish, read_world, write_structure, write_world
from voxquarry.operators import voxels as V
from voxquarry.sources import sinks
from voxquarry.sources.world_source import tables


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("worlds")
    w = world(12)
    publish(str(top / "overworld.w"), write_world(w, stats=True))
    publish(str(top / "nether.w"), write_indexed(w))
    return top, w


def test_minimal_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    publish(path, MINIMAL)
    t = tables(spark, path)
    assert [tuple(r)[1:4] for r in t["block_palette"].collect()] == [(0, "minecraft:stone", [])]
    cells = V.voxels(t["sections"])
    assert cells.count() == 4096 and cells.agg(F.min("y"), F.max("y")).first()[:] == (-64, -49)
    assert {r["top"] for r in V.height_map(cells, []).collect()} == {-49}
    assert t["worlds"].first()["block_version"] == VERSION


def test_round_trip(spark, files, tmp_path):
    top, w = files
    t = tables(spark, str(top), columns_per_task=5)
    assert t["columns"].count() == 24 and t["worlds"].count() == 2
    out = sinks.write_worlds(sinks.from_read(t), str(tmp_path / "out"))
    assert {r["content_hash"] for r in out.collect()} == {content_hash(w)}
    for name in ("overworld", "nether"):
        assert content_hash(read_world((tmp_path / "out" / f"{name}.world").read_bytes())) == content_hash(w)
    again = sinks.write_worlds(sinks.from_read(t), str(tmp_path / "log"), mode="indexed").collect()
    assert all(content_hash(read_world(open(r["path"], "rb").read())) == content_hash(w) for r in again)


def test_pushdown(spark, files):
    top, _ = files
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        t = tables(spark, str(top / "nether.w"), pushdown="true")
        rows = t["columns"].filter("x = -2 AND z = -1").collect()
        assert len(rows) == 1 and t["sections"].filter("x < 0").select("x").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_canonical_refs_match_the_writer(spark, files, tmp_path):
    top, w = files
    t = tables(spark, str(top / "nether.w"))
    sections = V.trimmed(t["sections"], t["block_palette"])
    refs = V.canonical_refs(t["block_palette"], V.reference_counts(sections, t["scheduled_updates"]))
    names = {r["new_ref"]: r["name"] for r in refs.join(t["block_palette"], ["world_id", "ref"]).collect()}
    want = [s.name for s in read_world(write_world(w)).states]
    assert [names[i] for i in range(len(names))] == want
    elected = V.biome_election(t["biome_sections"], t["biome_palette"]).first()
    solid = read_world(write_world(w))
    assert solid.biomes[solid.flags >> 16] == elected["name"]


def test_counts_and_build(spark, files):
    top, _ = files
    t = tables(spark, str(top / "nether.w"))
    counted = {(r["state_ref"]): r["cells"] for r in V.state_counts(t["sections"]).collect()}
    by_cell = {r["state_ref"]: r["count"] for r in V.voxels(t["sections"]).groupBy("state_ref").count().collect()}
    assert counted == by_cell
    cells = V.voxels(t["sections"]).filter("layer = 0")
    rebuilt = V.build_sections(cells, air=-1)
    assert V.voxels(rebuilt).exceptAll(cells).count() == 0


def test_structure_views(spark, tmp_path):
    cells = np.zeros(4096, np.int64)
    cells[2 << 8 | 1 << 4 | 0] = 1
    s = Structure(VERSION, [state("minecraft:air", VERSION), state("minecraft:stone", VERSION)], (5, 1, 3), (0, 0, 0), [[Storage.of(cells)]])
    path = str(tmp_path / "s")
    publish(path, write_structure(s))
    t = tables(spark, path)
    flat = V.structure_voxels(t["cells"], t["structures"])
    assert flat.count() == 15
    stone = t["block_palette"].filter("name = 'minecraft:stone'").first()["ref"]
    turned = V.rotated_cells(flat, (5, 1, 3)).filter(F.col("state_ref") == stone).collect()
    assert [(r["x"], r["y"], r["z"]) for r in turned] == [(1, 0, 2)]
    assert V.export_single_layer(flat, t["block_palette"]).agg(F.sum("id")).first()[0] == 1
    assert V.export_layers(flat, (5, 1, 3)).filter(F.col("block") == stone).first()["flat"] == 2 * 1 * 3 + 0 + 1
