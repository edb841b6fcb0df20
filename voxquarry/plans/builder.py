"""Building worlds from edits: single blocks, boxes, biomes, entities, updates.

Edits are rows with a running number; boxes expand and overlaps resolve in Spark,
the last edit of a cell winning, and sections come out of one grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.codec.model import BYTE, INT, PLAINS, State, entity, without_position
from voxquarry.operators import space, voxels
from voxquarry.sources import sinks
from voxquarry.sources.rows import SCHEMAS, state_row


class WorldBuilder:
    """Collects edits; ``tables`` gives the world they make."""

    def __init__(self, spark: SparkSession, block_version: int, low: int = -4, high: int = 19, world_id: str = "overworld"):
        self.spark, self.version, self.low, self.high, self.world_id = spark, block_version, low, high, world_id
        self.states: dict[State, int] = {State("minecraft:air", (), block_version): 0}
        self.biomes: dict[str, int] = {PLAINS: 0}
        self.boxes: list[tuple] = []
        self.areas: list[tuple] = []
        self.block_entities: dict[tuple, tuple] = {}
        self.entities: list[tuple] = []
        self.updates: list[tuple] = []
        self.column_data: dict[tuple[int, int], bytes] = {}
        self.user_data = self.settings = b""

    def ref(self, s: State) -> int:
        return self.states.setdefault(s, len(self.states))

    def set_block(self, x: int, y: int, z: int, s: State, layer: int = 0) -> "WorldBuilder":
        return self.fill((x, y, z), (x, y, z), s, layer)

    def fill(self, a: tuple[int, int, int], b: tuple[int, int, int], s: State, layer: int = 0) -> "WorldBuilder":
        """An inclusive box between two corners in any order."""
        if not all(self.low * 16 <= y <= self.high * 16 + 15 for y in (a[1], b[1])):
            raise ValueError("a block lies outside the world's height")
        self.boxes.append((len(self.boxes), *a, *b, layer, self.ref(s)))
        return self

    def set_biome(self, x: int, z: int, section_y: int, name: str) -> "WorldBuilder":
        """Biome of one section of the chunk column at (x, z)."""
        self.areas.append((len(self.areas), x, z, section_y, self.biomes.setdefault(name, len(self.biomes))))
        return self

    def add_block_entity(self, x: int, y: int, z: int, data: bytes) -> "WorldBuilder":
        self.block_entities[x, y, z] = (self.world_id, x, y, z, without_position(data), None)
        return self

    def add_entity(self, x: float, z: float, data: bytes) -> "WorldBuilder":
        ident, canonical = entity(data)
        self.entities.append((self.world_id, int(x // 16), int(z // 16), ident, canonical, None))
        return self

    def schedule(self, x: int, y: int, z: int, s: State, tick: int) -> "WorldBuilder":
        self.updates.append((self.world_id, x, y, z, self.ref(s), tick))
        return self

    def set_column_data(self, x: int, z: int, data: bytes) -> "WorldBuilder":
        self.column_data[x, z] = data
        return self

    def tables(self) -> sinks.WorldTables:
        spark, w = self.spark, self.world_id
        make = lambda rows, schema: spark.createDataFrame(rows, schema)
        boxes = make(self.boxes, "n int, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int, layer int, state_ref int")
        parts = []
        for layer in sorted({b[7] for b in self.boxes}):
            cells = space.fill_boxes(boxes.filter(F.col("layer") == layer), "n", "state_ref")
            parts.append(cells.select(F.lit(w).alias("world_id"), "x", "y", "z", F.lit(layer).alias("layer"), "state_ref"))
        empty = make([], "world_id string, x int, y int, z int, layer int, state_ref int")
        cells = empty
        for p in parts:
            cells = cells.unionByName(p)
        sections = self._with_inner_layers(voxels.build_sections(cells))
        data = make([(x, z, d) for (x, z), d in self.column_data.items()], "x int, z int, user_data binary")
        areas = make(self.areas, "n int, x int, z int, section_y int, ref int")
        chunks = sections.select("x", "z").unionByName(areas.select("x", "z")).unionByName(data.select("x", "z"))
        points = make([(r[1], r[3]) for r in self.block_entities.values()] + [(r[1], r[3]) for r in self.updates], "x int, z int")
        chunks = chunks.unionByName(points.select(F.shiftright("x", 4).alias("x"), F.shiftright("z", 4).alias("z")))
        chunks = chunks.unionByName(make([(r[1], r[2]) for r in self.entities], "x int, z int")).distinct()
        columns = chunks.join(data, ["x", "z"], "left").select(
            F.lit(w).alias("world_id"), "x", "z", F.lit(None).cast("bigint").alias("morton"), F.lit(self.low).alias("min_section"),
            F.lit(self.high - self.low + 1).alias("section_count"), F.lit(0).cast("bigint").alias("tick"), F.coalesce("user_data", F.lit(b"")).alias("user_data"),
        )
        chosen = areas.groupBy("x", "z", "section_y").agg(F.max_by("ref", "n").alias("ref"))
        every = chunks.withColumn("section_y", F.explode(F.sequence(F.lit(self.low), F.lit(self.high))))
        biome_sections = every.join(chosen, ["x", "z", "section_y"], "left").select(
            F.lit(w).alias("world_id"), "x", "z", "section_y", F.array(F.coalesce("ref", F.lit(0))).alias("palette"), F.lit(None).cast("binary").alias("indices")
        )
        return sinks.WorldTables(
            make([(w, "world", "solid", 0, self.version, self.settings, None, None, self.user_data, None)], SCHEMAS["worlds"]),
            make([(w, *state_row(i, s)) for s, i in self.states.items()], SCHEMAS["block_palette"]),
            make([(w, i, name) for name, i in self.biomes.items()], SCHEMAS["biome_palette"]),
            columns, sections, biome_sections, None,
            make(list(self.block_entities.values()), SCHEMAS["block_entities"]), make(self.entities, SCHEMAS["entities"]),
            make(self.updates, SCHEMAS["scheduled_updates"]),
        )

    @staticmethod
    def _with_inner_layers(sections: DataFrame) -> DataFrame:
        """Layers below a stored one are there too, as air."""
        key = ["world_id", "x", "z", "section_y"]
        full = sections.groupBy(*key).agg(F.max("layer").alias("top")).withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("top")))).drop("top")
        joined = full.join(sections, [*key, "layer"], "left")
        return joined.withColumn("palette", F.coalesce("palette", F.array(F.lit(0)))).select(*key, "layer", "palette", "indices")

    def save(self, folder: str, mode: str = "solid", **options) -> DataFrame:
        return sinks.write_worlds(self.tables(), folder, mode, **options)


__all__ = ["BYTE", "INT", "WorldBuilder"]
