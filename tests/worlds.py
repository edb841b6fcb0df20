"""Worlds that several tests use."""

import numpy as np

from voxquarry.codec import nbt
from voxquarry.codec.model import Column, State, Storage, World, state

VERSION = 18040335
# Fixed bytes of three published files.
MINIMAL = bytes.fromhex(
    "50494c4502000000180000000f4613010000010f6d696e6563726166743a73746f6e650000010f6d696e6563726166743a6f6365616e010100000100000701010100000000000000"
    "346da78b53f5a5f70000000000000000000000000000000000000000000000000000000000000000454c4950"
)
EMPTY_CHUNK = bytes.fromhex(
    "50494c4502000000180000000f46130100000000010f6d696e6563726166743a6f6365616e00010000071800000000000000000000008bf8f060bd65f268"
    "0000000000000000000000000000000000000000000000000000000000000000454c4950"
)
WITH_STATS = bytes.fromhex(
    "50494c45020000001a0000000f46130100006b0a000004060062696f6d65730100000000000000040b00626c6f636b53746174657301000000000000000406006368756e6b73"
    "0100000000000000040e0066696c6c656453656374696f6e730100000000000000040b00756e69717565426c6f6273010000000000000000010f6d696e6563726166743a7374"
    "6f6e650000010f6d696e6563726166743a6f6365616e010100000100000701010100000000000000d4cf32c88f4948700000000000000000000000000000000000000000000000"
    "000000000000000000454c4950"
)


def states(n: int) -> list[State]:
    return [state("minecraft:air", VERSION), state("minecraft:water", VERSION, liquid_depth=0)] + [
        state(f"minecraft:block_{i}", VERSION, kind=i, lit=bool(i % 2), label=f"n{i}") for i in range(n)
    ]


def column(x: int, z: int, n_states: int = 20, seed: int = 42, sections: int = 4) -> Column:
    rng = np.random.default_rng([seed, x & 0xFFFF, z & 0xFFFF])
    layers: list[list[Storage]] = []
    for i in range(sections):
        if i == 0:
            layers.append([])
        elif i == 1:
            layers.append([Storage((2,)), Storage.of(np.where(rng.random(4096) < 0.1, 1, 0))])
        else:
            layers.append([Storage.of(rng.integers(0, n_states + 2, 4096))])
    biomes = [Storage((int(rng.integers(0, 2)),)) for _ in range(sections)]
    be = nbt.encode({"id": (nbt.STRING, "Chest"), "x": (nbt.INT, 1)})
    ent = nbt.encode({"UniqueID": (nbt.LONG, x * 1000 + z), "Pos": (nbt.LIST, (nbt.FLOAT, [1.0, 2.0, 3.0]))})
    return Column(
        x, z, -1, layers, biomes, None, [(x * 16 + 3, 5, z * 16 + 4, be), (x * 16 + 1, 2, z * 16 + 2, be)], [(x * 1000 + z, ent)], 77,
        [(x * 16 + 5, 1, z * 16 + 5, 3, 100)], b"user",
    )


def world(n: int = 4, n_states: int = 20) -> World:
    settings = nbt.encode({"name": (nbt.STRING, "w"), "time": (nbt.LONG, 6000), "other": (nbt.SHORT, 3)})
    return World(VERSION, states(n_states), ["minecraft:plains", "minecraft:ocean"], [column(i % 16 - 2, i // 16 - 1, n_states) for i in range(n)], settings, b"blob")
