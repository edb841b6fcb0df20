"""Rotation, builders and file verdicts."""

import numpy as np
from pyspark.sql import functions as F
from test_codec import NEGATIVE
from worlds import MINIMAL, VERSION, states

from voxquarry.codec import nbt
from voxquarry.codec.model import State, Storage, Structure, state
from voxquarry.codec.rotate import rotate
from voxquarry.codec.solid import content_hash, read_world, write_structure
from voxquarry.operators import space
from voxquarry.plans.builder import WorldBuilder
from voxquarry.sources.validate import violations


def box(size, seed=1):
    rng = np.random.default_rng(seed)
    n = 1
    for v in size:
        n *= -(-v // 16)
    ent = nbt.encode({"Pos": (nbt.LIST, (nbt.FLOAT, [1.0, 2.0, 3.0])), "Yaw": (nbt.FLOAT, 10.0)})
    cells = [[Storage.of(rng.integers(0, 6, 4096)), Storage.of(rng.integers(0, 2, 4096))] if i % 2 == 0 else [] for i in range(n)]
    return Structure(VERSION, states(4), size, (4, 5, 6), cells, [(1, 2, 3, nbt.encode({"id": (nbt.STRING, "Chest")}))], [ent])


def test_four_turns():
    s = box((20, 5, 33))
    turned = s
    for _ in range(4):
        turned = rotate(turned)
    s.origin = (0, 0, 0)
    assert content_hash(turned) == content_hash(s) and rotate(s, 4) is s
    assert rotate(s).size == (33, 5, 20) and write_structure(rotate(s, 5), "none") == write_structure(rotate(s), "none")
    assert rotate(s).block_entities[0][:3] == (33 - 1 - 3, 2, 1)
    root = nbt.decode(rotate(s).entities[0])
    assert root["Pos"][1][1] == [30.0, 2.0, 1.0] and root["Yaw"][1] == 100.0


def test_properties():
    s = Structure(
        VERSION,
        [state("minecraft:air", VERSION), state("minecraft:oak_stairs", VERSION, weirdo_direction=0), state("minecraft:oak_log", VERSION, pillar_axis="x"),
         State("minecraft:chest", (("minecraft:cardinal_direction", 2, "north"),), VERSION), State("minecraft:bed", (("direction", 0, 3),), VERSION)],
        (16, 1, 16), (0, 0, 0), [[Storage.of(np.arange(4096) % 5)]],
    )
    by = {st.name: st.props for st in rotate(s).states}
    assert by["minecraft:oak_stairs"][0][2] == 2 and by["minecraft:oak_log"][0][2] == "z"
    assert by["minecraft:chest"][0][2] == "east" and by["minecraft:bed"][0] == ("direction", 0, 0)


def test_rotation_columns(spark):
    df = spark.createDataFrame([(1.0, 3.0, 350.0)], "x float, z float, yaw float")
    x, z, yaw = space.rotate_entity(F.col("x"), F.col("z"), F.col("yaw"), 33.0)
    assert tuple(df.select(x, z, yaw).first()) == (30.0, 1.0, 80.0)
    assert space.turned("ground_sign_direction", 15) == 3 and space.turned("facing_direction", 1) == 1 and space.turned("other", 1) == 1


def test_builder(spark, tmp_path):
    stone, water = state("minecraft:stone", VERSION), state("minecraft:water", VERSION)
    b = WorldBuilder(spark, VERSION, 0, 1).fill((-3, 4, 2), (17, 0, -2), stone).set_block(0, 1, 0, water).set_block(1, 1, 1, water, layer=1)
    b.set_biome(0, 0, 1, "minecraft:ocean").schedule(0, 1, 0, water, 50).set_column_data(5, 5, b"far").add_block_entity(2, 2, 2, nbt.encode({"id": (nbt.STRING, "X")}))
    b.add_entity(-1.0, 3.0, nbt.encode({"UniqueID": (nbt.LONG, 9)}))
    (saved,) = b.save(str(tmp_path / "o")).collect()
    w = read_world(open(saved["path"], "rb").read())
    at = {(c.x, c.z): c for c in w.columns}
    assert set(at) == {(x, z) for x in (-1, 0, 1) for z in (-1, 0)} | {(5, 5)} and at[5, 5].user_data == b"far"
    name = lambda x, y, z, layer=0: w.states[at[x >> 4, z >> 4].sections[y >> 4][layer].at(x & 15, y & 15, z & 15)].name
    assert name(-3, 0, -2) == "minecraft:stone" and name(0, 1, 0) == "minecraft:water" and name(1, 1, 1, 1) == "minecraft:water" and name(0, 9, 0) == "minecraft:air"
    assert w.biomes[at[0, 0].biomes[1].refs[0]] == "minecraft:ocean" and at[0, 0].updates[0][4] == 50 and at[-1, 0].entities[0][0] == 9


def test_violations(spark, tmp_path):
    for name, (data, _, _) in NEGATIVE.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "good").write_bytes(MINIMAL)
    found = {r["path"].rsplit("/", 1)[1]: r for r in violations(spark, str(tmp_path)).collect()}
    assert found.pop("good")["content_hash"] == "91e8c6cec870044e"
    for name, (_, kind, fragment) in NEGATIVE.items():
        assert found[name]["status"] == kind.__name__ and fragment in found[name]["detail"]
    assert violations(spark, str(tmp_path / "good"), budget=10).first()["status"] == "budget"
