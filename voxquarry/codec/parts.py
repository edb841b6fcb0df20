"""Palettes, section blobs and chunk records: the parts that all file modes share."""

from __future__ import annotations

import numpy as np

from . import nbt
from .limits import (
    CELLS, COST_COLUMN, COST_ENTRY, COST_STORAGE, LIGHT, MAX_BLOBS, MAX_LAYERS, MAX_LOCAL, MAX_PALETTE, MAX_PER_CHUNK, MAX_PROPERTIES,
    MAX_SECTIONS, SECTION_HIGH, SECTION_LOW, Budget, Corrupt, InvalidContent,
)
from .model import BYTE, INT, PLAINS, TEXT, Column, State, Storage, entity, unique_id, without_position
from .wire import Cursor, bitset, blob, hash64, svarint, string, uvarint



# ---- palettes


def read_states(c: Cursor, version: int) -> list[State]:
    n = c.count(MAX_PALETTE, "block palette")
    if n > c.left // 2:
        raise Corrupt(f"block palette of {n} entries doesn't fit the data")
    raw = []
    for _ in range(n):
        name, props, last = c.string(), [], None
        for _ in range(c.count(MAX_PROPERTIES, "property")):
            key = c.string()
            if last is not None and key.encode() <= last:
                raise Corrupt(f"state properties must ascend: {key!r}")
            last = key.encode()
            kind = c.fixed("B")
            if kind not in (BYTE, INT, TEXT):
                raise Corrupt(f"property type {kind} is not defined")
            props.append((key, kind, c.fixed("B") if kind == BYTE else c.fixed("i") if kind == INT else c.string()))
        raw.append((name, tuple(props)))
    versions, at = [version] * n, 0
    for k in range(c.count(n, "override")):
        step = c.uvarint()
        if k and not step:
            raise Corrupt("palette overrides must be strictly ascending")
        at += step
        if at >= 1 << 64:
            raise Corrupt("override index chain wraps")
        if at >= n:
            raise Corrupt(f"override index {at} is out of range")
        versions[at] = c.fixed("i")
        if not versions[at]:
            raise Corrupt("a version override must not be zero")
        if versions[at] == version:
            raise Corrupt("a version override equals the palette's own version")
    states = [State(name, props, v) for (name, props), v in zip(raw, versions)]
    if len(set(states)) != n:
        raise Corrupt("duplicate block palette entry")
    return states


def write_states(states: list[State], version: int) -> bytes:
    out = uvarint(len(states)) + b"".join(s.entry() for s in states)
    other = [(i, s.version) for i, s in enumerate(states) if s.version not in (0, version)]
    out += uvarint(len(other))
    last = 0
    for i, v in other:
        out += uvarint(i - last) + v.to_bytes(4, "little", signed=True)
        last = i
    return out


def read_biomes(c: Cursor) -> list[str]:
    n = c.count(MAX_PALETTE, "biome palette")
    if n > c.left:
        raise Corrupt(f"biome palette of {n} entries doesn't fit the data")
    names = []
    for _ in range(n):
        names.append(c.string())
        if ":" not in names[-1]:
            raise Corrupt(f"biome name {names[-1]!r} is not namespaced")
    if len(set(names)) != n:
        raise Corrupt("duplicate biome palette entry")
    return names


def write_biomes(names: list[str]) -> bytes:
    for name in names:
        if ":" not in name:
            raise InvalidContent(f"biome name {name!r} is not namespaced")
    return uvarint(len(names)) + b"".join(map(string, names))


# ---- blobs


def read_blob(c: Cursor) -> Storage:
    n = c.count(MAX_LOCAL, "local palette")
    if not n:
        raise Corrupt("a section blob has an empty palette")
    if n > c.left:
        raise Corrupt("a local palette doesn't fit the data")
    refs = []
    for _ in range(n):
        r = c.uvarint()
        if r > MAX_PALETTE:
            raise Corrupt(f"palette reference {r} exceeds limit {MAX_PALETTE}")
        if refs and r <= refs[-1]:
            raise Corrupt("local palette references are not strictly ascending")
        refs.append(r)
    width = c.fixed("B")
    if width > 2:
        raise Corrupt(f"index width {width} is not defined")
    if n == 1:
        if width:
            raise Corrupt("a single-entry palette must use the uniform width")
        return Storage((refs[0],))
    if width != (1 if n <= 256 else 2):
        raise Corrupt(f"non-minimal index width {width} for {n} entries")
    indices = np.frombuffer(c.take(CELLS * width), dtype="<u1" if width == 1 else "<u2").astype(np.uint16)
    seen = np.zeros(MAX_LOCAL, bool)
    seen[indices] = True
    if seen[n:].any():
        raise Corrupt(f"block index {int(indices.max())} is out of palette range {n}")
    if not seen[:n].all():
        raise Corrupt(f"local palette entry {int(np.flatnonzero(~seen[:n])[0])} is never used by the indices")
    return Storage(tuple(refs), indices)


def write_blob(s: Storage, final: dict[int, int]) -> bytes:
    """Canonical blob: references through ``final``, ascending, only those in use, narrowest indices."""
    if s.indices is None:
        return uvarint(1) + uvarint(final[s.refs[0]]) + b"\0"
    used = s.used()
    refs = sorted({final[r] for r in used})
    if len(refs) == 1:
        return uvarint(1) + uvarint(refs[0]) + b"\0"
    place = {r: i for i, r in enumerate(refs)}
    table = np.array([place[final[r]] if r in final else 0 for r in s.refs], dtype=np.uint16)
    width = 1 if len(refs) <= 256 else 2
    return uvarint(len(refs)) + b"".join(map(uvarint, refs)) + bytes([width]) + table[s.indices].astype("<u1" if width == 1 else "<u2").tobytes()


def read_blob_table(c: Cursor) -> list[Storage]:
    n = c.count(MAX_BLOBS, "blob table")
    if n > c.left // 3:
        raise Corrupt(f"blob table of {n} entries doesn't fit the data")
    out, seen = [], {}
    for i in range(n):
        start = c.at
        out.append(read_blob(c))
        raw = c.data[start : c.at]
        if raw in seen:
            raise Corrupt(f"blob {i} repeats blob {seen[raw]}")
        seen[raw] = i
    return out


class TableBlobs:
    """Blobs by reference into a table, in first-use order."""

    def __init__(self, table: list[Storage]):
        self.table, self.seen = table, 0

    def __call__(self, c: Cursor) -> Storage:
        i = c.uvarint()
        if i >= len(self.table):
            raise Corrupt(f"blob reference {i} is out of range")
        if i > self.seen:
            raise Corrupt(f"blob reference {i} breaks first-use order, next is {self.seen}")
        self.seen += i == self.seen
        return self.table[i]

    def finish(self) -> None:
        if self.seen != len(self.table):
            raise Corrupt(f"blob {self.seen} is never referenced")


# ---- records


def check_layers(layers: list[Storage], states: list[State], what: str) -> None:
    for s in layers:
        for r in s.refs:
            if r >= len(states):
                raise Corrupt(f"block palette reference {r} is out of range")
    last = layers[-1]
    if last.uniform and states[last.refs[0]].air:
        raise Corrupt(f"{what} ends in an all-air layer, so it is either absent or shorter")


def read_layers(c: Cursor, blobs, budget: Budget, what: str) -> list[Storage]:
    n = c.count(MAX_LAYERS, "layer")
    if not n:
        raise Corrupt(f"{what} is present but declares no layers")
    budget.charge(n, COST_STORAGE)
    return [blobs(c) for _ in range(n)]


def _ascends(keys: list[tuple]) -> bool:
    return all(a < b for a, b in zip(keys, keys[1:]))


def synthetic_id(x: int, z: int, i: int) -> int:
    """Id of an entity that carries none, from where it stands in the file."""
    raw = x.to_bytes(4, "little", signed=True) + z.to_bytes(4, "little", signed=True) + i.to_bytes(8, "little")
    return hash64(raw) & ((1 << 63) - 1) or 1


def read_record(
    c: Cursor, x: int, z: int, blobs, states: list[State], biome_count: int, fallback: int, elided: bool, light: bool, budget: Budget
) -> Column:
    """A chunk record after its position; ``elided`` says that uniform ``fallback`` biomes must be absent."""
    where = f"chunk ({x},{z})"
    low, n = c.svarint(), c.count(MAX_SECTIONS, "section")
    if not n:
        raise Corrupt(f"{where} has no sections")
    if low < SECTION_LOW or low + n > SECTION_HIGH + 1:
        raise Corrupt(f"{where} spans sections {low}..{low + n - 1}, outside the addressable range")
    sections: list[list[Storage]] = [[] for _ in range(n)]
    present = c.bitset(n)
    for i in present:
        sections[i] = read_layers(c, blobs, budget, f"section {low + i}")
    biomes = [Storage((fallback,))] * n
    stored = c.bitset(n)
    for i in stored:
        biomes[i] = blobs(c)
    lights: list | None = None
    if light:
        lights = [None] * n
        for i in c.bitset(n):
            marks = c.fixed("B")
            if marks & ~3:
                raise Corrupt(f"light flags 0x{marks:02x} set reserved bits")
            if not marks:
                raise Corrupt(f"light entry for section {i} carries no arrays")
            lights[i] = (c.take(LIGHT) if marks & 1 else None, c.take(LIGHT) if marks & 2 else None)
    m = c.count(MAX_PER_CHUNK, "block entity")
    budget.charge(m, COST_ENTRY)
    bes = [(c.fixed("B"), c.svarint(), c.blob()) for _ in range(m)]
    m = c.count(MAX_PER_CHUNK, "entity")
    budget.charge(m, COST_ENTRY)
    entities = [c.blob() for _ in range(m)]
    tick = c.svarint()
    m = c.count(MAX_PER_CHUNK, "scheduled update")
    budget.charge(m, COST_ENTRY)
    updates = [(c.fixed("B"), c.svarint(), c.uvarint(), c.svarint()) for _ in range(m)]
    user = c.blob()

    for i in present:
        check_layers(sections[i], states, f"section {low + i}")
    for i in stored:
        if elided and biomes[i].uniform and biomes[i].refs[0] == fallback:
            raise Corrupt(f"section {low + i} stores biomes uniformly the file's default, which must be omitted")
        if max(biomes[i].refs) >= biome_count:
            raise Corrupt(f"biome palette reference {max(biomes[i].refs)} is out of range")
    span = range(low * 16, (low + n) * 16)
    if not _ascends([(y, p >> 4, p & 15) for p, y, _ in bes]):
        raise Corrupt(f"block entities are out of order or repeat a position in {where}")
    for p, y, data in bes:
        if y not in span:
            raise Corrupt(f"block entity at Y {y} is outside the chunk's span {span.start}..{span.stop - 1}")
        nbt.validate(data)
    made = []
    for i, data in enumerate(entities):
        nbt.validate(data)
        ident = unique_id(data)
        if ident is None:
            ident = synthetic_id(x, z, i)
            data = nbt.encode(nbt.decode(data) | {"UniqueID": (nbt.LONG, ident)})
        made.append((ident, data))
    for p, y, ref, at in updates:
        if ref >= len(states):
            raise Corrupt(f"scheduled update block reference {ref} is out of range")
        if y not in span:
            raise Corrupt(f"scheduled update at Y {y} is outside the chunk's span {span.start}..{span.stop - 1}")
    if not _ascends([(y, p >> 4, p & 15, at, ref) for p, y, ref, at in updates]):
        raise Corrupt(f"scheduled updates are out of order or repeat a key in {where}")
    return Column(
        x, z, low, sections, biomes, lights,
        [(x * 16 + (p & 15), y, z * 16 + (p >> 4), data) for p, y, data in bes], made, tick,
        [(x * 16 + (p & 15), y, z * 16 + (p >> 4), ref, at) for p, y, ref, at in updates], user,
    )


def trimmed(layers: list[Storage], states: list[State]) -> list[Storage]:
    """Layers without the all-air ones at the end; inner ones stay."""
    n = len(layers)
    while n and all(states[r].air for r in layers[n - 1].used()):
        n -= 1
    return layers[:n]


def check_column(col: Column, states: list[State], biomes: list[str]) -> None:
    """Refuse what a reader would refuse."""
    where = f"chunk ({col.x},{col.z})"
    n = len(col.sections)
    if not 1 <= n <= MAX_SECTIONS or col.min_section < SECTION_LOW or col.min_section + n > SECTION_HIGH + 1:
        raise InvalidContent(f"{where} spans no valid range of sections")
    span = range(col.min_section * 16, (col.min_section + n) * 16)
    for what, points in (("block entity", [p[:3] for p in col.block_entities]), ("scheduled update", [p[:3] for p in col.updates])):
        for x, y, z in points:
            if (x >> 4, z >> 4) != (col.x, col.z) or y not in span:
                raise InvalidContent(f"{what} at ({x},{y},{z}) lies outside {where}")
    if len({p[:3] for p in col.block_entities}) != len(col.block_entities):
        raise InvalidContent(f"{where} has two block entities at one position")
    if len({(x, y, z, at, states[ref]) for x, y, z, ref, at in col.updates}) != len(col.updates):
        raise InvalidContent(f"{where} repeats a scheduled update")
    for ident, data in col.entities:
        if entity(data)[0] != ident:
            raise InvalidContent(f"an entity's UniqueID isn't {ident}")
    for layers in col.sections:
        if len(layers) > MAX_LAYERS or any(r >= len(states) or r < 0 for s in layers for r in s.refs):
            raise InvalidContent(f"{where} has dangling block references or too many layers")
    if len(col.biomes) not in (0, n) or any(r >= len(biomes) or r < 0 for s in col.biomes for r in s.refs):
        raise InvalidContent(f"{where} has dangling biome references")
    if max(len(col.block_entities), len(col.entities), len(col.updates)) > MAX_PER_CHUNK:
        raise InvalidContent(f"{where} has too many entries")


def write_record(
    col: Column, states: list[State], block_ids: dict[int, int], biome_ids: dict[int, int] | None, default: int | None, light: bool, put
) -> bytes:
    """A chunk record after its position; ``put(blob)`` gives what stands for a blob in it.

    ``block_ids`` and ``biome_ids`` give final references (``None``: leave biomes
    out); ``default`` is the final reference of the elided biome.
    """
    n = len(col.sections)
    out = [svarint(col.min_section), uvarint(n)]
    kept = [trimmed(layers, states) for layers in col.sections]
    out.append(bitset(n, [i for i in range(n) if kept[i]]))
    for layers in kept:
        if layers:
            out.append(uvarint(len(layers)))
            out += [put(write_blob(s, block_ids)) for s in layers]
    stored = []
    if biome_ids is not None:
        for i, s in enumerate(col.biomes):
            used = {biome_ids[r] for r in s.used()}
            if used != {default}:
                stored.append(i)
    out.append(bitset(n, stored))
    out += [put(write_blob(col.biomes[i], biome_ids)) for i in stored]
    if light:
        lights = col.light or [None] * n
        lit = [i for i, v in enumerate(lights) if v and (v[0] is not None or v[1] is not None)]
        out.append(bitset(n, lit))
        for i in lit:
            a, b = lights[i]
            out += [bytes([(a is not None) | (b is not None) << 1]), a or b"", b or b""]
    bes = sorted((y, z, x, without_position(data)) for x, y, z, data in col.block_entities)
    out.append(uvarint(len(bes)))
    out += [bytes([(x & 15) | (z & 15) << 4]) + svarint(y) + blob(data) for y, z, x, data in bes]
    entities = sorted((ident, nbt.canonical(data)) for ident, data in col.entities)
    out.append(uvarint(len(entities)))
    out += [blob(data) for _, data in entities]
    updates = sorted((y, z, x, at, block_ids[ref]) for x, y, z, ref, at in col.updates)
    out += [svarint(col.tick), uvarint(len(updates))]
    out += [bytes([(x & 15) | (z & 15) << 4]) + svarint(y) + uvarint(ref) + svarint(at) for y, z, x, at, ref in updates]
    out.append(blob(col.user_data))
    return b"".join(out)


def charge_column(budget: Budget) -> None:
    budget.charge(1, COST_COLUMN)


def plains_ref(biomes: list[str]) -> tuple[list[str], int]:
    """Palette with the fallback biome in it, and where it stands."""
    if PLAINS in biomes:
        return biomes, biomes.index(PLAINS)
    return [*biomes, PLAINS], len(biomes)


def spread(v: int) -> int:
    out = 0
    for i in range(32):
        out |= (v >> i & 1) << 2 * i
    return out


def morton(x: int, z: int) -> int:
    """Unsigned 64-bit Z-order key."""
    return spread((x + (1 << 31)) & 0xFFFFFFFF) | spread((z + (1 << 31)) & 0xFFFFFFFF) << 1
