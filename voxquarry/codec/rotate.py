"""Quarter turns of structures: cells, block entities, entities and state properties."""

from __future__ import annotations

import struct

import numpy as np

from voxquarry.operators.space import turned

from . import nbt
from .model import State, Storage, Structure
from .solid import cell_grid

_I = np.arange(4096)


def rotate_state(s: State, turns: int = 1) -> State:
    """Direction-like properties follow the turn; a byte stays a byte."""
    return State(s.name, tuple((k, t, turned(k, v, turns)) for k, t, v in s.props), s.version)


def _float(v: float) -> float:
    return struct.unpack("<f", struct.pack("<f", v))[0]


def rotate_entity(data: bytes, size_z: int) -> bytes:
    """Pos (three floats) and Yaw after one quarter turn; anything else stays."""
    if not data:
        return data
    root = nbt.decode(data, strict=False)
    pos = nbt.get(root, "Pos", nbt.LIST)
    if pos and pos[0] == nbt.FLOAT and len(pos[1]) == 3:
        x, y, z = pos[1]
        root["Pos"] = (nbt.LIST, (nbt.FLOAT, [_float(size_z - z), y, x]))
    yaw = nbt.get(root, "Yaw", nbt.FLOAT)
    if yaw is not None:
        root["Yaw"] = (nbt.FLOAT, _float((yaw + 90) % 360))
    return nbt.encode(root)


def _grid(s: Structure, layer: int) -> np.ndarray:
    """References of one layer over whole cells; -1 where a cell lacks the layer."""
    gx, gy, gz = s.grid
    out = np.full((gx * 16, gz * 16, gy * 16), -1, np.int64)
    for n, layers in enumerate(s.cells):
        if layer < len(layers):
            x, z, y = n // (gz * gy), n // gy % gz, n % gy
            out[x * 16 : x * 16 + 16, z * 16 : z * 16 + 16, y * 16 : y * 16 + 16] = layers[layer].cells().reshape(16, 16, 16)
    return out[: s.size[0], : s.size[2], : s.size[1]]


def rotate(s: Structure, turns: int = 1) -> Structure:
    """(x, z) goes to (size_z - 1 - z, x) on each turn; the origin of a turned structure is zero."""
    turns %= 4
    if not turns:
        return s
    states = list(s.states)
    if not any(st.air for st in states):
        states.append(State("minecraft:air", (), s.block_version))
    air = next(i for i, st in enumerate(states) if st.air)
    depth = max((len(layers) for layers in s.cells), default=0)
    size = (s.size[2], s.size[1], s.size[0])
    gx, gy, gz = (-(-v // 16) for v in size)
    cells: list[list[Storage]] = [[] for _ in range(cell_grid(size))]
    for layer in range(depth):
        source = _grid(s, layer)
        moved = np.full((gx * 16, gz * 16, gy * 16), -1, np.int64)
        moved[: size[0], : size[2], : size[1]] = source[:, ::-1].transpose(1, 0, 2)
        for n in range(len(cells)):
            x, z, y = n // (gz * gy), n // gy % gz, n % gy
            part = moved[x * 16 : x * 16 + 16, z * 16 : z * 16 + 16, y * 16 : y * 16 + 16].reshape(-1)
            if (part >= 0).any():
                cells[n] += [Storage((air,))] * (layer - len(cells[n])) + [Storage.of(np.where(part < 0, air, part))]
    bes = [(s.size[2] - 1 - z, y, x, data) for x, y, z, data in s.block_entities]
    ents = [rotate_entity(data, s.size[2]) for data in s.entities]
    once = Structure(s.block_version, [rotate_state(st) for st in states], size, (0, 0, 0), cells, bes, ents, s.user_data)
    return rotate(once, turns - 1)
