"""Writing worlds from tables.

Tables are gathered to one nested row per column by aggregation, which spreads
over the cluster; then one task writes each world, because blob ids follow the
order of first use and the body is hashed as one stream.  A world's body is at
most 512 MiB by the format, which bounds that task.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxquarry.codec.indexed import write_indexed
from voxquarry.codec.model import Column, World
from voxquarry.codec.solid import content_hash, write_world

from .rows import state_of, unpacked
from .world_source import store_of

KEY = ["world_id", "x", "z"]


@dataclass
class WorldTables:
    """The tables that make up worlds; optional ones may be left out."""

    worlds: DataFrame
    block_palette: DataFrame
    biome_palette: DataFrame
    columns: DataFrame
    sections: DataFrame
    biome_sections: DataFrame
    light: DataFrame | None = None
    block_entities: DataFrame | None = None
    entities: DataFrame | None = None
    scheduled_updates: DataFrame | None = None
    skip: set[str] = field(default_factory=set)


def gather(t: WorldTables) -> DataFrame:
    """One row per column with its parts as arrays."""
    out = t.columns.select(*KEY, "min_section", "section_count", "tick", "user_data")

    def add(name: str, df: DataFrame | None, *columns: str) -> None:
        nonlocal out
        if df is None or name in t.skip:
            out = out.withColumn(name, F.lit(None).cast("array<struct<none:int>>"))
            return
        part = df.groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias(name))
        out = out.join(part, KEY, "left")

    def by_chunk(df: DataFrame | None) -> DataFrame | None:
        # Absolute positions to their chunk; shifts floor where division would not.
        return df and df.select("world_id", F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz"), F.struct("*").alias("row")).select(
            "world_id", F.col("cx").alias("x"), F.col("cz").alias("z"), "row"
        )

    add("sections", t.sections, "section_y", "layer", "palette", "indices")
    add("biomes", t.biome_sections, "section_y", "palette", "indices")
    add("light", t.light, "section_y", "block_light", "sky_light")
    add("block_entities", by_chunk(t.block_entities), "row")
    add("entities", t.entities and t.entities.withColumnsRenamed({"chunk_x": "x", "chunk_z": "z"}), "unique_id", "nbt")
    add("updates", by_chunk(t.scheduled_updates), "row")
    return out


def stem_of(world_id: str) -> str:
    """File name of a world without its folders and extension."""
    name = os.path.basename(world_id)
    return name.rsplit(".", 1)[0] or name


def _items(v) -> list:
    return [] if v is None else list(v)


def column_of(r) -> Column:
    low, n = int(r.min_section), int(r.section_count)
    sections: list[list] = [[] for _ in range(n)]
    for s in sorted(_items(r.sections), key=lambda s: (s["section_y"], s["layer"])):
        sections[s["section_y"] - low].append(unpacked(s["palette"], s["indices"]))
    biomes = [unpacked(s["palette"], s["indices"]) for s in sorted(_items(r.biomes), key=lambda s: s["section_y"])]
    light: list | None = None
    for s in _items(r.light):
        light = light or [None] * n
        light[s["section_y"] - low] = tuple(None if v is None else bytes(v) for v in (s["block_light"], s["sky_light"]))
    bes = [(p["x"], p["y"], p["z"], bytes(p["nbt"])) for p in (s["row"] for s in _items(r.block_entities))]
    ents = [(s["unique_id"], bytes(s["nbt"])) for s in _items(r.entities)]
    updates = [(p["x"], p["y"], p["z"], p["state_ref"], p["tick"]) for p in (s["row"] for s in _items(r.updates))]
    return Column(int(r.x), int(r.z), low, sections, biomes, light, bes, ents, int(r.tick), updates, bytes(r.user_data))


def _writer(folder: str, mode: str, level: str, stats: bool, light: bool, skip_biomes: bool, extension: str):
    def run(key: tuple, columns: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
        head = meta.iloc[0]
        states = [state_of(s["name"], s["props"], s["version"]) for s in sorted(head.states, key=lambda s: s["ref"])]
        names = [b["name"] for b in sorted(_items(head.biomes), key=lambda b: b["ref"])]
        w = World(int(head.block_version), states, names, [column_of(r) for r in columns.itertuples(index=False)], bytes(head.settings), bytes(head.user_data))
        data = write_indexed(w, level) if mode == "indexed" else write_world(w, level, stats, light, skip_biomes)
        stem = stem_of(key[0]) if head.sharers == 1 else f"{stem_of(key[0])}-{xxhash.xxh64_hexdigest(key[0].encode())}"
        store, top = store_of(folder)
        store.create_dir(top, recursive=True)
        path, own = f"{top}/{stem}.{extension}", f"{top}/.{stem}-{uuid.uuid4().hex}"
        with store.open_output_stream(own, compression=None) as f:
            f.write(data)
        store.move(own, path)
        return pd.DataFrame([{"world_id": key[0], "path": f"{folder}/{stem}.{extension}", "bytes": len(data), "content_hash": content_hash(w)}])

    return run


def write_worlds(
    t: WorldTables, folder: str, mode: str = "solid", level: str = "default", stats: bool = False, light: bool = True,
    skip_biomes: bool = False, extension: str = "world",
) -> DataFrame:
    """Write each world of the tables to ``folder``; (world_id, path, bytes, content_hash), lazily."""
    states = t.block_palette.groupBy("world_id").agg(F.collect_list(F.struct("ref", "name", "props", "version")).alias("states"))
    biomes = t.biome_palette.groupBy("world_id").agg(F.collect_list(F.struct("ref", "name")).alias("biomes"))
    meta = t.worlds.select("world_id", "block_version", "settings", "user_data").join(states, "world_id", "left").join(biomes, "world_id", "left")
    # Worlds whose names differ only in their folders get a hash of the whole name into the file's.
    stem = F.regexp_replace(F.regexp_extract("world_id", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = t.worlds.select("world_id", stem.alias("stem"))
    sharers = named.join(named.groupBy("stem").agg(F.countDistinct("world_id").alias("sharers")), "stem").select("world_id", "sharers")
    meta = meta.join(sharers, "world_id").withColumn("states", F.coalesce("states", F.array().cast(states.schema["states"].dataType)))
    write = _writer(folder, mode, level, stats, light, skip_biomes, extension)
    return gather(t).groupBy("world_id").cogroup(meta.groupBy("world_id")).applyInPandas(write, "world_id string, path string, bytes bigint, content_hash string")


def from_read(tables: dict[str, DataFrame]) -> WorldTables:
    names = ("worlds", "block_palette", "biome_palette", "columns", "sections", "biome_sections", "light", "block_entities", "entities", "scheduled_updates")
    return WorldTables(**{n: tables[n] for n in names})

