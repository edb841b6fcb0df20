"""Solid files: worlds and structures in one compressed body."""

from __future__ import annotations

import os
import tempfile
from collections import Counter

import numpy as np

from . import nbt
from .limits import (
    DEFAULT_BUDGET, FOOTER_MAGIC, FOOTER_SIZE, HEADER_MAGIC, HEADER_SIZE, MAX_AXIS, MAX_BODY, MAX_CELLS, MAX_CHUNKS, MAX_PER_CHUNK, VERSION,
    Budget, ChecksumMismatch, Corrupt, InvalidContent, UnknownFlags, UnsupportedMode, UnsupportedVersion,
)
from .model import PLAINS, State, Storage, Structure, World, without_position
from .parts import (
    charge_column, check_column, check_layers, morton, plains_ref, read_biomes, read_blob_table, read_layers, read_record, read_states, TableBlobs,
    trimmed, write_biomes, write_blob, write_record, write_states,
)
from .wire import Cursor, bitset, blob, compress, decompress, hash64, svarint, uvarint

WORLD, STRUCTURE = 0, 1
SOLID, INDEXED = 0, 1
STORE_LIGHT, STATS, DEFAULT_BIOME, UNCOMPRESSED = 1, 2, 8, 16
KNOWN_FLAGS = STORE_LIGHT | STATS | DEFAULT_BIOME | UNCOMPRESSED | 0xFFFF0000


# ---- container


def read_header(data: bytes) -> tuple[int, int, int, int]:
    """(kind, mode, flags, block version), each checked."""
    if len(data) < HEADER_SIZE + FOOTER_SIZE:
        raise Corrupt(f"file too short ({len(data)} bytes)")
    if data[:4] != HEADER_MAGIC:
        raise Corrupt("bad header magic")
    c = Cursor(data[:HEADER_SIZE], 4)
    version, kind, mode, flags, block_version = c.fixed("H"), c.fixed("B"), c.fixed("B"), c.fixed("I"), c.fixed("i")
    if version != VERSION:
        raise UnsupportedVersion(f"unsupported format version {version}, this reader handles {VERSION}")
    if kind > STRUCTURE:
        raise Corrupt(f"file kind {kind} is not defined")
    if not block_version:
        raise Corrupt("blockVersion is zero")
    if flags & ~KNOWN_FLAGS:
        raise UnknownFlags(f"unknown required feature flags 0x{flags:08x}")
    if not flags & DEFAULT_BIOME and flags >> 16:
        raise Corrupt("default biome reference set without its flag")
    return kind, mode, flags, block_version


def open_solid(data: bytes, kind: int) -> tuple[Cursor, int, int]:
    """Body, flags and block version of a whole, verified file of this kind."""
    found, mode, flags, version = read_header(data)
    if mode != SOLID:
        raise UnsupportedMode(f"unsupported body mode {mode}")
    foot = Cursor(data, len(data) - FOOTER_SIZE)
    want, controls, magic = foot.fixed("Q"), [foot.fixed("Q") for _ in range(4)], foot.take(4)
    if magic != FOOTER_MAGIC:
        raise Corrupt("bad footer magic")
    for name, v in zip(("directory offset", "directory length", "generation", "previous footer"), controls):
        if v:
            raise Corrupt(f"{name} must be zero in a solid file")
    if hash64(data[: len(data) - FOOTER_SIZE], data[len(data) - FOOTER_SIZE + 8 :]) != want:
        raise ChecksumMismatch("body checksum mismatch")
    if found != kind:
        raise Corrupt(f"file kind {found} where {kind} was wanted")
    stored = data[HEADER_SIZE : len(data) - FOOTER_SIZE]
    if flags & UNCOMPRESSED:
        if len(stored) > MAX_BODY:
            raise Corrupt(f"body of {len(stored)} bytes, limit {MAX_BODY}")
        body = stored
    else:
        body = decompress(stored)
    return Cursor(body), flags, version


def seal(kind: int, flags: int, version: int, body: bytes, level: str, threads: int = 0) -> bytes:
    if len(body) > MAX_BODY:
        raise InvalidContent(f"body of {len(body)} bytes, limit {MAX_BODY}")
    if not version:
        raise InvalidContent("blockVersion is zero")
    if level == "none":
        flags |= UNCOMPRESSED
    head = header(kind, SOLID, flags, version)
    stored = compress(body, level, threads=threads)
    tail = bytes(32) + FOOTER_MAGIC
    return head + stored + hash64(head, stored, tail).to_bytes(8, "little") + tail


def header(kind: int, mode: int, flags: int, version: int) -> bytes:
    return HEADER_MAGIC + VERSION.to_bytes(2, "little") + bytes([kind, mode]) + flags.to_bytes(4, "little") + version.to_bytes(4, "little", signed=True)


def resealed(data: bytes) -> bytes:
    """The same bytes with a right checksum."""
    at = len(data) - FOOTER_SIZE
    return data[:at] + hash64(data[:at], data[at + 8 :]).to_bytes(8, "little") + data[at + 8 :]


def publish(path: str, data: bytes) -> None:
    """Write beside, flush to disk, rename over."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
        folder_handle = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(folder_handle)
        finally:
            os.close(folder_handle)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


# ---- meta block


def read_meta(c: Cursor, flags: int) -> tuple[bytes, bytes, bytes | None]:
    settings, user = c.blob(), c.blob()
    stats = c.blob() if flags & STATS else None
    nbt.check_tags(settings, nbt.SETTINGS)
    if stats is not None:
        if not stats:
            raise Corrupt("the stats compound is empty")
        nbt.check_tags(stats, nbt.STATS)
    return settings, user, stats


def check_meta(settings: bytes) -> None:
    try:
        nbt.check_tags(settings, nbt.SETTINGS)
    except Corrupt as e:
        raise InvalidContent(f"settings: {e}") from None


# ---- worlds: reading


def read_meta_only(data: bytes) -> World:
    """Header and metadata; no palette or record is decoded."""
    kind = read_header(data)[0]
    if data[7] == INDEXED and kind == WORLD:
        from .indexed import IndexedFile

        return IndexedFile(data).world([])
    c, flags, version = open_solid(data, kind)
    settings, user, stats = read_meta(c, flags)
    return World(version, [], [], [], settings, user, stats, flags)


def read_palette_only(data: bytes) -> list[State]:
    kind = read_header(data)[0]
    if data[7] == INDEXED and kind == WORLD:
        from .indexed import IndexedFile

        return IndexedFile(data).states
    c, flags, version = open_solid(data, kind)
    read_meta(c, flags)
    return read_states(c, version)


def read_world(data: bytes, budget: int = DEFAULT_BUDGET) -> World:
    if len(data) > 7 and data[7] == INDEXED and read_header(data)[0] == WORLD:
        from .indexed import IndexedFile

        return IndexedFile(data, budget).whole()
    c, flags, version = open_solid(data, WORLD)
    settings, user, stats = read_meta(c, flags)
    states, names = read_states(c, version), read_biomes(c)
    table = read_blob_table(c)
    elided = bool(flags & DEFAULT_BIOME)
    stored = len(names)
    if elided:
        fallback = flags >> 16
        if fallback >= stored:
            raise Corrupt(f"default biome reference {fallback} is out of range")
    else:
        names, fallback = plains_ref(names)
    blobs, left, columns, lit = TableBlobs(table), Budget(budget), [], False
    x = z = 0
    last = -1
    for _ in range(c.count(MAX_CHUNKS, "chunk")):
        x, z = x + c.svarint(), z + c.svarint()
        if not (-(1 << 31) <= x < 1 << 31 and -(1 << 31) <= z < 1 << 31):
            raise Corrupt("chunk position out of range")
        key = morton(x, z)
        if key <= last:
            raise Corrupt(f"chunk ({x},{z}) is out of order or duplicated")
        last = key
        charge_column(left)
        columns.append(read_record(c, x, z, blobs, states, stored, fallback, elided, bool(flags & STORE_LIGHT), left))
        lit |= any(v is not None for v in columns[-1].light or ())
    c.done("after last chunk")
    blobs.finish()
    if flags & STORE_LIGHT and not lit:
        raise Corrupt("the light flag is set over records without light")
    return World(version, states, names, columns, settings, user, stats, flags)


# ---- worlds: writing


def ordered_states(counts: Counter, states: list[State], version: int) -> list[State]:
    """Canonical palette of the counted states; equal ones merge."""
    merged: Counter = Counter()
    for ref, n in counts.items():
        s = states[ref]
        merged[State(s.name, s.props, s.version or version)] += n
    return sorted(merged, key=lambda s: (-merged[s], s.entry(), 0 if s.version == version else s.version))


def count_column(col, states: list[State], blocks: Counter, biomes: Counter, uniform: Counter) -> None:
    for layers in col.sections:
        for s in trimmed(layers, states):
            blocks.update({states[r]: r for r in s.used()}.values())
    blocks.update(ref for *_, ref, _ in col.updates)
    for s in col.biomes:
        used = s.used()
        biomes.update(used)
        if len(used) == 1:
            uniform[used[0]] += 1


def elect(uniform: Counter, ids: dict[int, int]) -> int | None:
    """Final reference of the default biome; only the winner is tested against 16 bits."""
    if not uniform:
        return None
    votes: Counter = Counter()
    for ref, n in uniform.items():
        votes[ids[ref]] += n
    best = min(votes, key=lambda r: (-votes[r], r))
    return best if best < 1 << 16 else None


def write_world(w: World, level: str = "default", stats: bool = False, light: bool = True, skip_biomes: bool = False, threads: int = 0) -> bytes:
    check_meta(w.settings)
    columns = sorted(w.columns, key=lambda c: morton(c.x, c.z))
    for a, b in zip(columns, columns[1:]):
        if (a.x, a.z) == (b.x, b.z):
            raise InvalidContent(f"duplicate chunk ({a.x},{a.z})")
    blocks, biomes, uniform = Counter(), Counter(), Counter()
    for col in columns:
        check_column(col, w.states, w.biomes)
        count_column(col, w.states, blocks, biomes, uniform)
    palette = ordered_states(blocks, w.states, w.block_version)
    place = {s: i for i, s in enumerate(palette)}
    block_ids = {r: place[State(w.states[r].name, w.states[r].props, w.states[r].version or w.block_version)] for r in blocks}
    named: Counter = Counter()
    for r, n in biomes.items():
        named[w.biomes[r]] += n
    names = [] if skip_biomes else sorted(named, key=lambda b: (-named[b], b.encode()))
    at = {b: i for i, b in enumerate(names)}
    biome_ids = None if skip_biomes else {r: at[w.biomes[r]] for r in biomes}
    default = None if skip_biomes else elect(uniform, biome_ids)
    flags = 0
    if default is not None:
        flags |= DEFAULT_BIOME | default << 16
    light = light and any(v for col in columns for v in col.light or ())
    if light:
        flags |= STORE_LIGHT

    table: dict[bytes, int] = {}

    def put(raw: bytes) -> bytes:
        return uvarint(table.setdefault(raw, len(table)))

    records, px, pz, filled = [], 0, 0, 0
    for col in columns:
        records.append(svarint(col.x - px) + svarint(col.z - pz) + write_record(col, w.states, block_ids, biome_ids, default, light, put))
        px, pz = col.x, col.z
        filled += sum(bool(trimmed(layers, w.states)) for layers in col.sections)
    body = blob(w.settings) + blob(w.user_data)
    if stats:
        flags |= STATS
        numbers = {"chunks": len(columns), "filledSections": filled, "uniqueBlobs": len(table), "blockStates": len(palette), "biomes": len(names)}
        body += blob(nbt.encode({k: (nbt.LONG, v) for k, v in numbers.items()}))
    body += write_states(palette, w.block_version) + write_biomes(names) + uvarint(len(table)) + b"".join(table) + uvarint(len(columns)) + b"".join(records)
    return seal(WORLD, flags, w.block_version, body, level, threads)


def content_hash(w: World | Structure) -> str:
    """xxHash64 of the canonical uncompressed body without stats and light."""
    data = write_structure(w, "none") if isinstance(w, Structure) else write_world(w, "none", stats=False, light=False)
    return f"{hash64(data[HEADER_SIZE : len(data) - FOOTER_SIZE]):016x}"


# ---- structures


def cell_grid(size: tuple[int, int, int]) -> int:
    n = 1
    for v in size:
        n *= -(-v // 16)
    return n


def read_structure(data: bytes, budget: int = DEFAULT_BUDGET) -> Structure:
    c, flags, version = open_solid(data, STRUCTURE)
    if flags & ~UNCOMPRESSED:
        raise Corrupt(f"flags 0x{flags:08x} are not valid for a structure")
    settings, user, _ = read_meta(c, flags)
    if settings:
        raise Corrupt("structure settings must be empty")
    states = read_states(c, version)
    if read_biomes(c):
        raise Corrupt("the structure biome palette must be empty")
    blobs, left = TableBlobs(read_blob_table(c)), Budget(budget)
    size = tuple(c.uvarint() for _ in range(3))
    if not all(1 <= v <= MAX_AXIS for v in size):
        raise Corrupt(f"structure size {size} is out of range")
    origin = tuple(c.svarint() for _ in range(3))
    if not all(-(1 << 31) <= v < 1 << 31 for v in origin):
        raise Corrupt("structure origin is out of range")
    n = cell_grid(size)
    if n > MAX_CELLS:
        raise Corrupt(f"structure of {n} cells, limit {MAX_CELLS}")
    cells: list[list[Storage]] = [[] for _ in range(n)]
    for i in c.bitset(n):
        cells[i] = read_layers(c, blobs, left, f"cell {i}")
        check_layers(cells[i], states, f"cell {i}")
    entries, last = [], None
    m = c.count(MAX_PER_CHUNK, "block entity")
    left.charge(m, 256)
    for _ in range(m):
        x, y, z, raw = c.uvarint(), c.uvarint(), c.uvarint(), c.blob()
        if not (x < size[0] and y < size[1] and z < size[2]):
            raise Corrupt(f"block entity at ({x},{y},{z}) is outside structure {size}")
        if last is not None and (y, z, x) <= last:
            raise Corrupt("structure block entities are out of order or repeat a position")
        last = (y, z, x)
        if raw:
            nbt.validate(raw)
        entries.append((x, y, z, raw))
    m = c.count(MAX_PER_CHUNK, "entity")
    left.charge(m, 256)
    entities = [c.blob() for _ in range(m)]
    for raw in entities:
        if raw:
            nbt.validate(raw)
    c.done("after last entity")
    blobs.finish()
    return Structure(version, states, size, origin, cells, entries, entities, user)


def cleared(s: Structure) -> list[list[Storage]]:
    """Cells with air outside the box, as the writer stores them."""
    cx, cy, cz = s.grid
    air = next((i for i, st in enumerate(s.states) if st.air), None)
    i = np.arange(4096)
    x, z, y = i >> 8, (i >> 4) & 15, i & 15
    out = []
    for n, layers in enumerate(s.cells):
        gx, gz, gy = n // (cz * cy), (n // cy) % cz, n % cy
        outside = (gx * 16 + x >= s.size[0]) | (gy * 16 + y >= s.size[1]) | (gz * 16 + z >= s.size[2])
        if not layers or not outside.any():
            out.append(layers)
            continue
        made = []
        for layer in layers:
            cells = layer.cells().copy()
            cells[outside] = len(s.states) if air is None else air
            made.append(Storage.of(cells))
        out.append(made)
    return out


def write_structure(s: Structure, level: str = "default") -> bytes:
    if not all(1 <= v <= MAX_AXIS for v in s.size) or cell_grid(s.size) > MAX_CELLS or len(s.cells) != cell_grid(s.size):
        raise InvalidContent(f"structure of size {s.size} with {len(s.cells)} cells")
    states = s.states if any(st.air for st in s.states) else [*s.states, State("minecraft:air", (), s.block_version)]
    cells = [trimmed(layers, states) for layers in cleared(s)]
    blocks: Counter = Counter()
    for layers in cells:
        for layer in layers:
            blocks.update({states[r]: r for r in layer.used()}.values())
    palette = ordered_states(blocks, states, s.block_version)
    place = {st: i for i, st in enumerate(palette)}
    ids = {r: place[State(states[r].name, states[r].props, states[r].version or s.block_version)] for r in blocks}
    table: dict[bytes, int] = {}
    parts = []
    for layers in cells:
        if layers:
            parts.append(uvarint(len(layers)) + b"".join(uvarint(table.setdefault(write_blob(x, ids), len(table))) for x in layers))
    body = blob(b"") + blob(s.user_data) + write_states(palette, s.block_version) + write_biomes([]) + uvarint(len(table)) + b"".join(table)
    body += b"".join(map(uvarint, s.size)) + b"".join(map(svarint, s.origin)) + bitset(len(cells), [i for i, v in enumerate(cells) if v]) + b"".join(parts)
    for x, y, z, _ in s.block_entities:
        if not (0 <= x < s.size[0] and 0 <= y < s.size[1] and 0 <= z < s.size[2]):
            raise InvalidContent(f"block entity at ({x},{y},{z}) is outside the box")
    if len({p[:3] for p in s.block_entities}) != len(s.block_entities):
        raise InvalidContent("two block entities at one position")
    entries = sorted((y, z, x, without_position(raw) if raw else raw) for x, y, z, raw in s.block_entities)
    body += uvarint(len(entries)) + b"".join(uvarint(x) + uvarint(y) + uvarint(z) + blob(raw) for y, z, x, raw in entries)
    entities = sorted(nbt.canonical(raw) for raw in s.entities)
    body += uvarint(len(entities)) + b"".join(map(blob, entities))
    return seal(STRUCTURE, 0, s.block_version, body, level)


__all__ = [
    "PLAINS", "content_hash", "open_solid", "publish", "read_meta_only", "read_palette_only", "read_structure", "read_world", "resealed",
    "write_structure", "write_world",
]
