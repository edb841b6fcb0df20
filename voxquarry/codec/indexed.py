"""Indexed files: an append-only log of frames with checkpoints."""

from __future__ import annotations

import os

import zstandard

from . import nbt
from .limits import (
    DEFAULT_BUDGET, FOOTER_MAGIC, FOOTER_SIZE, HEADER_SIZE, MAX_CHUNKS, MAX_DICTIONARY, MAX_FRAME, MAX_PALETTE, MAX_RECOVERY, Budget,
    ChecksumMismatch, Corrupt, InvalidContent, UnsupportedMode,
)
from .model import Column, State, Storage, World
from .parts import charge_column, check_column, morton, plains_ref, read_biomes, read_blob, read_record, read_states, write_biomes, write_record, write_states
from .solid import DEFAULT_BIOME, INDEXED, STATS, STORE_LIGHT, UNCOMPRESSED, WORLD, check_meta, header, publish, read_header, read_meta
from .wire import Cursor, blob, compress, decompress, hash64, signed, svarint, uvarint

ABSENT = (0, 0, 0)
# When a shared dictionary is worth training.
DICT_SAMPLES, DICT_BYTES, DICT_MOST, DICT_MOST_BYTES, DICT_TARGET = 16, 64 << 10, 256, 8 << 20, 16 << 10
GARBAGE_LIMIT = 0.5


def inline(c: Cursor) -> Storage:
    return read_blob(c)


def write_ref(ref: tuple[int, int, int]) -> bytes:
    return uvarint(ref[0]) + uvarint(ref[1]) + ref[2].to_bytes(8, "little")


def write_directory(flags: int, version: int, meta, dictionary, blocks, biomes, entries) -> bytes:
    """``entries`` are (x, z, (offset, length, hash)) in Z-order."""
    out = [bytes([WORLD, INDEXED]), flags.to_bytes(4, "little"), version.to_bytes(4, "little", signed=True), write_ref(meta), write_ref(dictionary)]
    for refs in (blocks, biomes):
        out += [uvarint(len(refs)), *map(write_ref, refs)]
    out.append(uvarint(len(entries)))
    px = pz = po = 0
    for x, z, (offset, length, digest) in entries:
        out += [svarint(x - px), svarint(z - pz), svarint(offset - po), uvarint(length), digest.to_bytes(8, "little")]
        px, pz, po = x, z, offset
    return b"".join(out)


def write_footer(head: bytes, stored: bytes, at: int, generation: int, previous: int) -> bytes:
    controls = b"".join(v.to_bytes(8, "little") for v in (at, len(stored), generation, previous)) + FOOTER_MAGIC
    return hash64(head, stored, controls).to_bytes(8, "little") + controls


class Ranged:
    """Part of the bytes interface over a random-access file: what isn't asked for isn't read."""

    def __init__(self, source):
        self.source, self.size = source, source.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: slice | int):
        if isinstance(key, int):
            return self.source.read_at(1, key)[0]
        a, b, _ = key.indices(self.size)
        return self.source.read_at(max(0, b - a), a)

    def rfind(self, what: bytes, low: int, high: int) -> int:
        step = 1 << 16
        while high - low >= len(what):
            a = max(low, high - step)
            at = self[a:high].rfind(what)
            if at >= 0:
                return a + at
            if a == low:
                return -1
            high = a + len(what) - 1
        return -1


class IndexedFile:
    """An opened file: header, newest valid checkpoint, directory and palettes; records on demand."""

    def __init__(self, data: bytes, budget: int = DEFAULT_BUDGET):
        self.data, self.budget = data, Budget(budget)
        kind, mode, self.flags, self.version = read_header(data)
        if kind != WORLD or mode != INDEXED:
            raise UnsupportedMode(f"unsupported body mode {mode}")
        if self.flags & (STATS | DEFAULT_BIOME) or self.flags >> 16:
            raise Corrupt(f"flags 0x{self.flags:08x} are not valid for an indexed file")
        self.footer_at, stored, self.generation = self._adopt()
        self.directory_bytes = len(stored)
        c = Cursor(stored if self.flags & UNCOMPRESSED else decompress(stored))
        if (c.fixed("B"), c.fixed("B")) != (WORLD, INDEXED):
            raise Corrupt("the directory is not an indexed world's")
        if (c.fixed("I"), c.fixed("i")) != (self.flags, self.version):
            raise Corrupt("the directory prologue disagrees with the header")
        self.meta_ref, self.dict_ref = self._ref(c), self._ref(c)
        self.dictionary = self._frame(self.dict_ref, MAX_DICTIONARY, plain=True) if self.dict_ref[1] else None
        self.settings = self.user_data = b""
        if self.meta_ref[1]:
            m = Cursor(self._frame(self.meta_ref))
            self.settings, self.user_data, _ = read_meta(m, self.flags)
            m.done("in the metadata frame")
        self.states: list[State] = []
        self.block_refs = self._refs(c, "block palette segment")
        for ref in self.block_refs:
            s = Cursor(self._frame(ref))
            part = read_states(s, s.fixed("i"))
            if not part:
                raise Corrupt("empty block palette segment")
            s.done("in a block palette segment")
            self.states += part
        self.biomes: list[str] = []
        self.biome_refs = self._refs(c, "biome palette segment")
        for ref in self.biome_refs:
            s = Cursor(self._frame(ref))
            part = read_biomes(s)
            if not part:
                raise Corrupt("empty biome palette segment")
            s.done("in a biome palette segment")
            self.biomes += part
        if len(set(self.states)) != len(self.states) or len(set(self.biomes)) != len(self.biomes):
            raise Corrupt("palette segments repeat an entry")
        self.entries: dict[tuple[int, int], tuple[int, int, int]] = {}
        x = z = at = 0
        last = -1
        for _ in range(c.count(MAX_CHUNKS, "directory chunk")):
            x, z, at = x + c.svarint(), z + c.svarint(), at + c.svarint()
            length, digest = c.uvarint(), c.fixed("Q")
            if not (-(1 << 31) <= x < 1 << 31 and -(1 << 31) <= z < 1 << 31):
                raise Corrupt("indexed chunk position out of range")
            if not 0 < length <= MAX_FRAME or at < HEADER_SIZE or at + length > self.footer_at:
                raise Corrupt("indexed chunk frame out of bounds")
            key = morton(x, z)
            if key <= last:
                raise Corrupt("the indexed directory is out of order")
            last = key
            self.entries[x, z] = (at, length, digest)
        c.done("in the indexed directory")

    def _adopt(self) -> tuple[int, bytes, int]:
        """The newest footer that verifies; bytes torn behind it do no harm."""
        end, tried = len(self.data), 0
        while (found := self.data.rfind(FOOTER_MAGIC, HEADER_SIZE, end)) >= 0 and tried < MAX_RECOVERY:
            at, end, tried = found - (FOOTER_SIZE - 4), found + 3, tried + 1
            if at < HEADER_SIZE:
                break
            c = Cursor(self.data[at : at + FOOTER_SIZE])
            want, offset, length, generation, previous = (c.fixed("Q") for _ in range(5))
            if offset < HEADER_SIZE or not length or offset + length > at or (previous and not HEADER_SIZE <= previous < at):
                continue
            stored = self.data[offset : offset + length]
            if hash64(self.data[:HEADER_SIZE], stored, self.data[at + 8 : at + FOOTER_SIZE]) == want:
                return at, stored, generation
        raise Corrupt("no valid indexed footer found")

    def _ref(self, c: Cursor) -> tuple[int, int, int]:
        ref = c.uvarint(), c.uvarint(), c.fixed("Q")
        if not ref[1]:
            if ref != ABSENT:
                raise Corrupt("an absent frame reference is not zero")
        elif ref[0] < HEADER_SIZE or ref[1] > MAX_FRAME or ref[0] + ref[1] > self.footer_at:
            raise Corrupt("an indexed frame reference is out of bounds")
        return ref

    def _refs(self, c: Cursor, what: str) -> list[tuple[int, int, int]]:
        refs = [self._ref(c) for _ in range(c.count(MAX_PALETTE, what))]
        if any(not r[1] for r in refs):
            raise Corrupt(f"{what} has zero length")
        if any(b[0] <= a[0] for a, b in zip(refs, refs[1:])):
            raise Corrupt(f"{what} references are not ascending")
        return refs

    def _frame(self, ref: tuple[int, int, int], most: int = MAX_FRAME, plain: bool = False) -> bytes:
        stored = self.data[ref[0] : ref[0] + ref[1]]
        if hash64(stored) != ref[2]:
            raise ChecksumMismatch("frame checksum mismatch")
        return stored if self.flags & UNCOMPRESSED else decompress(stored, most, None if plain else self.dictionary)

    def positions(self) -> list[tuple[int, int]]:
        return list(self.entries)

    def column(self, x: int, z: int) -> Column | None:
        """Point lookup: one frame is read and checked."""
        ref = self.entries.get((x, z))
        if ref is None:
            return None
        charge_column(self.budget)
        c = Cursor(self._frame(ref))
        names, fallback = plains_ref(self.biomes)
        col = read_record(c, x, z, inline, self.states, len(self.biomes), fallback, False, bool(self.flags & STORE_LIGHT), self.budget)
        c.done("in an indexed chunk record")
        return col

    def world(self, columns: list[Column]) -> World:
        return World(self.version, self.states, plains_ref(self.biomes)[0], columns, self.settings, self.user_data, None, self.flags, "indexed")

    def whole(self) -> World:
        return self.world([self.column(x, z) for x, z in self.entries])


def encode_record(col: Column, states: list[State], biomes: list[str], light: bool) -> bytes:
    """A record frame's body: blobs inline, references as they are, every biome section stored."""
    check_column(col, states, biomes)
    same = {i: i for i in range(len(states))}
    return write_record(col, states, same, {i: i for i in range(len(biomes))}, None, light, lambda raw: raw)


def first_seen(w: World) -> tuple[list[State], list[str], World]:
    """Palettes in first-seen order over Z-ordered columns, and the world on them."""
    from .parts import trimmed

    columns = sorted(w.columns, key=lambda c: morton(c.x, c.z))
    states: dict[State, int] = {}
    names: dict[str, int] = {}

    def block(r: int) -> int:
        s = w.states[r]
        return states.setdefault(State(s.name, s.props, s.version or w.block_version), len(states))

    def moved(s: Storage, ident) -> Storage:
        used = set(s.used())
        return Storage(tuple(ident(r) if r in used else 0 for r in s.refs), s.indices)

    out = []
    for col in columns:
        check_column(col, w.states, w.biomes)
        sections = [[moved(s, block) for s in trimmed(layers, w.states)] for layers in col.sections]
        biomes = [moved(s, lambda r: names.setdefault(w.biomes[r], len(names))) for s in col.biomes]
        updates = [(x, y, z, block(ref), at) for x, y, z, ref, at in col.updates]
        out.append(Column(col.x, col.z, col.min_section, sections, biomes, col.light, col.block_entities, col.entities, col.tick, updates, col.user_data))
    return list(states), list(names), World(w.block_version, list(states), list(names), out, w.settings, w.user_data)


def write_indexed(w: World, level: str = "default", dictionary: bytes | None = None, light: bool | None = None) -> bytes:
    """A fresh file with one checkpoint and first-seen palettes."""
    check_meta(w.settings)
    if not w.block_version:
        raise InvalidContent("blockVersion is zero")
    states, names, moved = first_seen(w)
    for a, b in zip(moved.columns, moved.columns[1:]):
        if (a.x, a.z) == (b.x, b.z):
            raise InvalidContent(f"duplicate chunk ({a.x},{a.z})")
    light = any(v for c in moved.columns for v in c.light or ()) if light is None else light
    flags = (STORE_LIGHT if light else 0) | (UNCOMPRESSED if level == "none" else 0)
    frames: list[bytes] = []
    at = HEADER_SIZE

    def frame(body: bytes, known: bytes | None) -> tuple[int, int, int]:
        nonlocal at
        stored = compress(body, level, known)
        frames.append(stored)
        at += len(stored)
        return at - len(stored), len(stored), hash64(stored)

    dict_ref = frame(dictionary, None) if dictionary else ABSENT
    # A segment is written only if it holds something: readers refuse empty ones.
    version = w.block_version.to_bytes(4, "little", signed=True)
    blocks = [frame(version + write_states(states, w.block_version), dictionary)] if states else []
    biomes = [frame(write_biomes(names), dictionary)] if names else []
    meta = frame(blob(w.settings) + blob(w.user_data), dictionary) if w.settings or w.user_data else ABSENT
    entries = [(c.x, c.z, frame(encode_record(c, states, names, light), dictionary)) for c in moved.columns]
    stored = compress(write_directory(flags, w.block_version, meta, dict_ref, blocks, biomes, entries), level)
    head = header(WORLD, INDEXED, flags, w.block_version)
    return head + b"".join(frames) + stored + write_footer(head, stored, at, 1, 0)


def train_dictionary(bodies: list[bytes], level: str = "default") -> bytes | None:
    """A shared dictionary from an even sample of record bodies, if there is enough of them and it measurably wins."""
    step = max(1, -(-len(bodies) // DICT_MOST))
    samples, size = [], 0
    for body in bodies[::step]:
        # Cut, so that large bodies leave room for all of the world.
        samples.append(body[: DICT_MOST_BYTES // DICT_MOST])
        size += len(samples[-1])
    if level == "none" or len(samples) < DICT_SAMPLES or size < DICT_BYTES:
        return None
    try:
        made = zstandard.train_dictionary(DICT_TARGET, samples).as_bytes()
    except zstandard.ZstdError:
        return None
    without = sum(len(compress(b, level)) for b in samples)
    with_it = sum(len(compress(b, level, made)) for b in samples) + len(made)
    return made if with_it < without else None


class IndexedLog:
    """A mutable handle: stores and deletions append, a checkpoint makes them durable."""

    def __init__(self, path: str, level: str = "default", read_only: bool = False):
        self.path, self.level, self.read_only = path, level, read_only
        self._load()

    @classmethod
    def create(cls, path: str, block_version: int, level: str = "default", light: bool = False) -> "IndexedLog":
        publish(path, write_indexed(World(block_version, [], [], []), level, light=light))
        return cls(path, level)

    def _load(self) -> None:
        with open(self.path, "rb") as f:
            self.data = f.read()
        self.file = IndexedFile(self.data)
        if self.file.flags & UNCOMPRESSED:
            self.level = "none"
        elif self.level == "none":
            self.level = "default"
        self.states, self.biomes = list(self.file.states), list(self.file.biomes)
        self.written = len(self.states), len(self.biomes)
        self.entries = dict(self.file.entries)
        self.pending: dict[tuple[int, int], bytes | None] = {}
        self.settings, self.user_data, self.meta_dirty = self.file.settings, self.file.user_data, False

    def positions(self) -> list[tuple[int, int]]:
        live = set(self.entries) | {k for k, v in self.pending.items() if v is not None}
        return sorted(live - {k for k, v in self.pending.items() if v is None}, key=lambda p: morton(*p))

    def __contains__(self, key: tuple[int, int]) -> bool:
        return self.pending[key] is not None if key in self.pending else key in self.entries

    def column(self, x: int, z: int) -> Column | None:
        if (x, z) not in self.pending:
            return self.file.column(x, z)
        body = self.pending[x, z]
        if body is None:
            return None
        fallback = plains_ref(self.biomes)[1]
        return read_record(Cursor(body), x, z, inline, self.states, len(self.biomes), fallback, False, bool(self.file.flags & STORE_LIGHT), Budget())

    def _writable(self) -> None:
        if self.read_only:
            raise InvalidContent("the handle is read-only")

    def store(self, col: Column, states: list[State], biomes: list[str]) -> None:
        """Upsert a column that refers to these palettes; new entries are appended to the file's."""
        self._writable()
        check_column(col, states, biomes)
        known, named = {s: i for i, s in enumerate(self.states)}, {b: i for i, b in enumerate(self.biomes)}

        def block(r: int) -> int:
            s = State(states[r].name, states[r].props, states[r].version or self.file.version)
            if s not in known:
                known[s] = len(self.states)
                self.states.append(s)
            return known[s]

        def biome(r: int) -> int:
            if biomes[r] not in named:
                named[biomes[r]] = len(self.biomes)
                self.biomes.append(biomes[r])
            return named[biomes[r]]

        def moved(s: Storage, ident) -> Storage:
            used = set(s.used())
            return Storage(tuple(ident(r) if r in used else 0 for r in s.refs), s.indices)

        own = Column(
            col.x, col.z, col.min_section, [[moved(s, block) for s in layers] for layers in col.sections], [moved(s, biome) for s in col.biomes],
            col.light, col.block_entities, col.entities, col.tick, [(x, y, z, block(ref), at) for x, y, z, ref, at in col.updates], col.user_data,
        )
        self.pending[col.x, col.z] = encode_record(own, self.states, self.biomes, bool(self.file.flags & STORE_LIGHT))

    def delete(self, x: int, z: int) -> bool:
        self._writable()
        there = (x, z) in self
        if there:
            self.pending[x, z] = None
        return there

    def set_meta(self, settings: bytes, user_data: bytes) -> None:
        self._writable()
        check_meta(settings)
        self.settings, self.user_data, self.meta_dirty = settings, user_data, True

    def garbage_ratio(self) -> float:
        """Bytes that the newest checkpoint doesn't need, as a share of the file."""
        refs = [*self.entries.values(), self.file.meta_ref, self.file.dict_ref, *self.file.block_refs, *self.file.biome_refs]
        live = HEADER_SIZE + FOOTER_SIZE + self.file.directory_bytes + sum(r[1] for r in refs)
        return 1 - live / len(self.data)

    def checkpoint(self) -> bool:
        """Frames, then a flush, then directory and footer, then a flush; a torn tail leaves the checkpoint before."""
        self._writable()
        grown = (len(self.states), len(self.biomes)) != self.written
        if not self.pending and not self.meta_dirty and not grown:
            return False
        at = len(self.data)
        frames: list[bytes] = []

        def frame(body: bytes) -> tuple[int, int, int]:
            nonlocal at
            stored = compress(body, self.level, self.file.dictionary)
            frames.append(stored)
            at += len(stored)
            return at - len(stored), len(stored), hash64(stored)

        f = self.file
        blocks, biomes, meta = list(f.block_refs), list(f.biome_refs), f.meta_ref
        if len(self.states) > self.written[0]:
            blocks.append(frame(f.version.to_bytes(4, "little", signed=True) + write_states(self.states[self.written[0] :], f.version)))
        if len(self.biomes) > self.written[1]:
            biomes.append(frame(write_biomes(self.biomes[self.written[1] :])))
        if self.meta_dirty:
            meta = frame(blob(self.settings) + blob(self.user_data)) if self.settings or self.user_data else ABSENT
        entries = dict(self.entries)
        for key, body in self.pending.items():
            if body is None:
                entries.pop(key, None)
            else:
                entries[key] = frame(body)
        ordered = [(x, z, entries[x, z]) for x, z in sorted(entries, key=lambda p: morton(*p))]
        stored = compress(write_directory(f.flags, f.version, meta, f.dict_ref, blocks, biomes, ordered), self.level)
        foot = write_footer(self.data[:HEADER_SIZE], stored, at, f.generation + 1, f.footer_at)
        with open(self.path, "r+b") as out:
            out.truncate(len(self.data))
            out.seek(0, os.SEEK_END)
            for part in frames:
                out.write(part)
            out.flush()
            os.fsync(out.fileno())
            out.write(stored + foot)
            out.flush()
            os.fsync(out.fileno())
        self._load()
        return True

    def compact(self) -> None:
        """Rewrite what is live in Z-order, with a dictionary where one wins, and swap it in."""
        self._writable()
        self.checkpoint()
        w = self.file.whole()
        dictionary = train_dictionary([encode_record(c, w.states, w.biomes, bool(self.file.flags & STORE_LIGHT)) for c in w.columns], self.level)
        publish(self.path, write_indexed(w, self.level, dictionary, bool(self.file.flags & STORE_LIGHT)))
        self._load()

    def close(self) -> None:
        if not self.read_only:
            self.checkpoint()
            if self.garbage_ratio() > GARBAGE_LIMIT:
                self.compact()


def append_indexed(path: str, w: World) -> None:
    """A new checkpoint that holds this world's columns; palettes and metadata must be what they are."""
    log = IndexedLog(path)
    if (w.block_version, w.states, w.settings, w.user_data) != (log.file.version, log.states, log.settings, log.user_data) or w.biomes not in (log.biomes, plains_ref(log.biomes)[0]):
        raise InvalidContent("an append needs unchanged palettes and metadata")
    for key in log.positions():
        log.delete(*key)
    for col in w.columns:
        log.store(col, w.states, w.biomes)
    log.checkpoint()


__all__ = ["IndexedFile", "IndexedLog", "append_indexed", "encode_record", "nbt", "signed", "train_dictionary", "write_indexed"]
