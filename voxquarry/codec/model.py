"""What a world file holds, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from . import nbt
from .limits import CELLS, Corrupt, InvalidContent, MAX_PROPERTIES
from .wire import string

BYTE, INT, TEXT = 0, 1, 2
AIR = "minecraft:air"
PLAINS = "minecraft:plains"


@dataclass(frozen=True)
class State:
    """A block state; properties are (key, type, value), keys ascending bytewise."""

    name: str
    props: tuple[tuple[str, int, int | str], ...] = ()
    version: int = 0

    @property
    def air(self) -> bool:
        return self.name == AIR and not self.props

    def entry(self) -> bytes:
        """Encoded entry, without its version: the palette's second sort key."""
        if len(self.props) > MAX_PROPERTIES:
            raise InvalidContent(f"{len(self.props)} properties, limit {MAX_PROPERTIES}")
        out = string(self.name) + bytes([len(self.props)])
        for key, kind, value in sorted(self.props, key=lambda p: p[0].encode()):
            out += string(key) + bytes([kind])
            out += bytes([value]) if kind == BYTE else value.to_bytes(4, "little", signed=True) if kind == INT else string(value)
        return out

    def __str__(self) -> str:
        inner = ",".join(f"{k}={v}" for k, _, v in self.props)
        return f"{self.name}[{inner}]@{self.version}" if inner else f"{self.name}@{self.version}"


def state(name: str, version: int, **props) -> State:
    """A state with int and str properties; True and False are byte properties."""
    made = [(k, BYTE if isinstance(v, bool) else INT if isinstance(v, int) else TEXT, int(v) if isinstance(v, bool) else v) for k, v in props.items()]
    return State(name, tuple(sorted(made, key=lambda p: p[0].encode())), version)


@dataclass(frozen=True, eq=False)
class Storage:
    """A 16x16x16 cube: references, and for more than one the index of each cell in (x, z, y) order."""

    refs: tuple[int, ...]
    indices: np.ndarray | None = None

    @staticmethod
    def of(cells: np.ndarray) -> "Storage":
        """From the reference of every cell; the palette is in first-seen order."""
        values, first, inverse = np.unique(cells, return_index=True, return_inverse=True)
        if len(values) == 1:
            return Storage((int(values[0]),))
        order = np.argsort(first)
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        return Storage(tuple(values[order].tolist()), rank[inverse].astype(np.uint16))

    @property
    def uniform(self) -> bool:
        return self.indices is None

    def used(self) -> list[int]:
        """Distinct references that some cell has, in palette order."""
        if self.indices is None:
            return [self.refs[0]]
        return list(dict.fromkeys(self.refs[i] for i in np.unique(self.indices).tolist()))

    def cells(self) -> np.ndarray:
        if self.indices is None:
            return np.full(CELLS, self.refs[0], np.int64)
        return np.array(self.refs, np.int64)[self.indices]

    def at(self, x: int, y: int, z: int) -> int:
        return self.refs[0] if self.indices is None else self.refs[self.indices[x << 8 | z << 4 | y]]

    def __eq__(self, other):
        return isinstance(other, Storage) and np.array_equal(self.cells(), other.cells())


@dataclass
class Column:
    """One chunk column; ``sections[i]`` lists the layers of a section, or is empty for air."""

    x: int
    z: int
    min_section: int
    sections: list[list[Storage]]
    biomes: list[Storage]
    light: list[tuple[bytes | None, bytes | None] | None] | None = None
    block_entities: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    entities: list[tuple[int, bytes]] = field(default_factory=list)
    tick: int = 0
    updates: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # x, y, z, ref, at
    user_data: bytes = b""


@dataclass
class World:
    block_version: int
    states: list[State]
    biomes: list[str]
    columns: list[Column]
    settings: bytes = b""
    user_data: bytes = b""
    stats: bytes | None = None
    flags: int = 0
    mode: str = "solid"


@dataclass
class Structure:
    block_version: int
    states: list[State]
    size: tuple[int, int, int]
    origin: tuple[int, int, int]
    cells: list[list[Storage]]
    block_entities: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    entities: list[bytes] = field(default_factory=list)
    user_data: bytes = b""

    @property
    def grid(self) -> tuple[int, int, int]:
        return tuple(-(-n // 16) for n in self.size)


def without_position(data: bytes) -> bytes:
    """A block entity's compound as stored."""
    root = nbt.decode(data, strict=False) if data else {}
    return nbt.encode({k: v for k, v in root.items() if k not in ("x", "y", "z")})


def with_position(data: bytes, x: int, y: int, z: int) -> bytes:
    root = nbt.decode(data, strict=False) if data else {}
    return nbt.encode(root | {"x": (nbt.INT, x), "y": (nbt.INT, y), "z": (nbt.INT, z)})


def unique_id(data: bytes) -> int | None:
    try:
        return nbt.get(nbt.decode(data, strict=False), "UniqueID", nbt.LONG)
    except Corrupt:
        return None


def entity(data: bytes) -> tuple[int, bytes]:
    """(id, canonical bytes) of an entity; it must carry its id."""
    ident = unique_id(data)
    if ident is None:
        raise InvalidContent("an entity has no UniqueID of type LONG")
    return ident, nbt.canonical(data)


def renamed(s: State, version: int) -> State:
    return replace(s, version=version)
