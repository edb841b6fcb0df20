"""Rows of each table of a decoded world, and worlds out of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from voxquarry.codec import nbt
from voxquarry.codec.model import BYTE, INT, Column, State, Storage, Structure, World
from voxquarry.codec.parts import morton

PROPS = "ARRAY<STRUCT<key: STRING, type: TINYINT, int_val: INT, str_val: STRING>>"
_SETTING = {nbt.STRING: "STRING", nbt.INT: "INT", nbt.LONG: "BIGINT", nbt.BYTE: "TINYINT"}
SETTINGS = "STRUCT<" + ", ".join(f"{k}: {_SETTING[t]}" for k, t in nbt.SETTINGS.items()) + ">"
STATS = "STRUCT<" + ", ".join(f"{k}: BIGINT" for k in nbt.STATS) + ">"
SCHEMAS = {
    "worlds": f"world_id STRING, kind STRING, mode STRING, flags BIGINT, block_version INT, settings BINARY, settings_s {SETTINGS}, settings_extra STRING, user_data BINARY, stats {STATS}",
    "block_palette": f"world_id STRING, ref INT, name STRING, props {PROPS}, version INT, entry BINARY",
    "biome_palette": "world_id STRING, ref INT, name STRING",
    "columns": "world_id STRING, x INT, z INT, morton BIGINT, min_section INT, section_count INT, tick BIGINT, user_data BINARY",
    "sections": "world_id STRING, x INT, z INT, section_y INT, layer INT, palette ARRAY<INT>, indices BINARY",
    "biome_sections": "world_id STRING, x INT, z INT, section_y INT, palette ARRAY<INT>, indices BINARY",
    "light": "world_id STRING, x INT, z INT, section_y INT, block_light BINARY, sky_light BINARY",
    "block_entities": "world_id STRING, x INT, y INT, z INT, nbt BINARY, nbt_json STRING",
    "entities": "world_id STRING, chunk_x INT, chunk_z INT, unique_id BIGINT, nbt BINARY, nbt_json STRING",
    "scheduled_updates": "world_id STRING, x INT, y INT, z INT, state_ref INT, tick BIGINT",
    "structures": "world_id STRING, block_version INT, size ARRAY<INT>, origin ARRAY<INT>, user_data BINARY",
    "cells": "world_id STRING, cell INT, layer INT, palette ARRAY<INT>, indices BINARY",
}
#: Tables that need no record.
META_TABLES = ("worlds", "block_palette", "biome_palette")


def signed(v: int, bits: int = 64) -> int:
    return v - (1 << bits) if v >> (bits - 1) else v


def packed(s: Storage) -> tuple[list[int], bytes | None]:
    return list(s.refs), None if s.indices is None else s.indices.astype("<u2").tobytes()


def unpacked(palette, indices) -> Storage:
    return Storage(tuple(int(r) for r in palette), None if indices is None else np.frombuffer(bytes(indices), dtype="<u2").astype(np.uint16))


def state_row(ref: int, s: State) -> tuple:
    props = [(k, t, v if t in (BYTE, INT) else None, v if t not in (BYTE, INT) else None) for k, t, v in s.props]
    return ref, s.name, props, s.version, s.entry()


def state_of(name: str, props, version: int) -> State:
    return State(name, tuple((p["key"], int(p["type"]), int(p["int_val"]) if p["type"] in (BYTE, INT) else p["str_val"]) for p in props), int(version))


def meta_rows(world_id: str, table: str, w: World) -> Iterator[tuple]:
    if table == "worlds":
        known, extra = nbt.settings(w.settings)
        stats = nbt.decode(w.stats) if w.stats else None
        yield (
            world_id, "world", w.mode, w.flags, w.block_version, w.settings, tuple(known.values()), json.dumps(nbt.plain(nbt.COMPOUND, extra)), w.user_data,
            tuple(nbt.get(stats, k, nbt.LONG) for k in nbt.STATS) if stats is not None else None,
        )
    elif table == "block_palette":
        for i, s in enumerate(w.states):
            yield (world_id, *state_row(i, s))
    elif table == "biome_palette":
        for i, name in enumerate(w.biomes):
            yield world_id, i, name


def column_rows(world_id: str, table: str, c: Column) -> Iterator[tuple]:
    at = (world_id, c.x, c.z)
    if table == "columns":
        yield (*at, signed(morton(c.x, c.z)), c.min_section, len(c.sections), c.tick, c.user_data)
    elif table == "sections":
        for i, layers in enumerate(c.sections):
            for n, s in enumerate(layers):
                yield (*at, c.min_section + i, n, *packed(s))
    elif table == "biome_sections":
        for i, s in enumerate(c.biomes):
            yield (*at, c.min_section + i, *packed(s))
    elif table == "light":
        for i, v in enumerate(c.light or ()):
            if v is not None:
                yield (*at, c.min_section + i, *v)
    elif table == "block_entities":
        for x, y, z, data in c.block_entities:
            yield world_id, x, y, z, data, nbt.to_json(data)
    elif table == "entities":
        for ident, data in c.entities:
            yield (*at, ident, data, nbt.to_json(data))
    elif table == "scheduled_updates":
        for x, y, z, ref, tick in c.updates:
            yield world_id, x, y, z, ref, tick


def structure_rows(world_id: str, table: str, s: Structure) -> Iterator[tuple]:
    if table == "structures":
        yield world_id, s.block_version, list(s.size), list(s.origin), s.user_data
    elif table == "block_palette":
        for i, st in enumerate(s.states):
            yield (world_id, *state_row(i, st))
    elif table == "cells":
        for i, layers in enumerate(s.cells):
            for n, layer in enumerate(layers):
                yield (world_id, i, n, *packed(layer))
    elif table == "block_entities":
        for x, y, z, data in s.block_entities:
            yield world_id, x, y, z, data, nbt.to_json(data) if data else None
    elif table == "entities":
        for data in s.entities:
            root = nbt.decode(data) if data else {}
            yield world_id, 0, 0, nbt.get(root, "UniqueID", nbt.LONG), data, nbt.to_json(data) if data else None
