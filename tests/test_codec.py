"""The world codec: published bytes, refusals, canonical form, logs."""

import random

import numpy as np
import pytest
from worlds import EMPTY_CHUNK, MINIMAL, VERSION, WITH_STATS, column, states, world

from voxquarry.codec import nbt
from voxquarry.codec.indexed import IndexedFile, IndexedLog, append_indexed, train_dictionary, write_indexed
from voxquarry.codec.limits import (
    BudgetExceeded, ChecksumMismatch, Corrupt, InvalidContent, UnknownFlags, UnsupportedMode, UnsupportedVersion, WorldError,
)
from voxquarry.codec.model import Column, State, Storage, Structure, World, state
from voxquarry.codec.parts import morton
from voxquarry.codec.solid import (
    cell_grid, content_hash, publish, read_meta_only, read_palette_only, read_structure, read_world, resealed, write_structure, write_world,
)
from voxquarry.codec.wire import Cursor, compress, decompress, hash64, svarint, uvarint


@pytest.mark.parametrize(
    "data, file_hash, content",
    [(MINIMAL, "d5930d68b2ae0e7d", "91e8c6cec870044e"), (EMPTY_CHUNK, "1bba1f960ce9d7d6", "4fefb9dd3629f90e"), (WITH_STATS, "54880df2e6e3aaf6", "91e8c6cec870044e")],
)
def test_published_files(data, file_hash, content):
    w = read_world(data)
    assert f"{hash64(data):016x}" == file_hash and content_hash(w) == content
    assert write_world(w, "none", stats=w.stats is not None) == data


def test_minimal_content():
    w = read_world(MINIMAL)
    (c,) = w.columns
    assert w.states == [State("minecraft:stone", (), VERSION)] and w.biomes == ["minecraft:ocean"]
    assert (c.x, c.z, c.min_section, len(c.sections), c.tick) == (0, 0, -4, 1, 0)
    assert c.sections[0][0].at(3, 4, 5) == 0 and c.biomes[0].refs == (0,)
    assert read_palette_only(MINIMAL) == w.states and read_meta_only(MINIMAL).block_version == VERSION


def edited(data: bytes, at: int, new: bytes, old: int | None = None, seal: bool = True) -> bytes:
    out = data[:at] + new + data[at + (len(new) if old is None else old) :]
    return resealed(out) if seal else out


STONE = MINIMAL[18:36]
NEGATIVE = {
    "magic": (edited(MINIMAL, 3, b"\x46"), Corrupt, "bad header magic"),
    "version": (edited(MINIMAL, 4, b"\x03"), UnsupportedVersion, "version 3"),
    "kind": (edited(MINIMAL, 6, b"\x02"), Corrupt, "file kind 2 is not defined"),
    "mode": (edited(MINIMAL, 7, b"\x02"), UnsupportedMode, "mode 2"),
    "structure_indexed": (edited(MINIMAL, 6, b"\x01\x01"), UnsupportedMode, "mode 1"),
    "block_version": (edited(MINIMAL, 12, bytes(4)), Corrupt, "blockVersion is zero"),
    "bit2": (edited(MINIMAL, 8, b"\x1c"), UnknownFlags, "0x0000001c"),
    "bit8": (edited(MINIMAL, 9, b"\x01"), UnknownFlags, "0x00000118"),
    "dimension": (edited(MINIMAL, 8, b"\xf8"), UnknownFlags, "0x000000f8"),
    "ref_without_flag": (edited(MINIMAL, 8, b"\x10\x00\x01\x00"), Corrupt, "default biome reference set without its flag"),
    "footer_magic": (edited(MINIMAL, 115, b"\x51"), Corrupt, "bad footer magic"),
    "generation": (edited(MINIMAL, 96, b"\x01"), Corrupt, "generation must be zero"),
    "hash": (edited(MINIMAL, 58, b"\x00", seal=False), ChecksumMismatch, "checksum mismatch"),
    "overlong": (edited(MINIMAL, 58, b"\x81\x00", 1), Corrupt, "non-minimal uvarint"),
    "padding": (edited(MINIMAL, 63, b"\x03"), Corrupt, "padding bits in bitset"),
    "utf8": (edited(MINIMAL, 20, b"\xff"), Corrupt, "not valid UTF-8"),
    "twice": (edited(MINIMAL, 18, b"\x02" + STONE[1:18] + STONE[1:18], 18), Corrupt, "duplicate block palette entry"),
    "bare_biome": (edited(MINIMAL, 38, b"\x05ocean", 16), Corrupt, "is not namespaced"),
    "repeated_blob": (edited(MINIMAL, 54, b"\x02\x01\0\0\x01\0\0", 4), Corrupt, "repeats blob"),
    "wide_uniform": (edited(MINIMAL, 55, b"\x01\x00\x01" + bytes(4096), 3), Corrupt, "single-entry palette must use the uniform width"),
    "no_layers": (edited(MINIMAL, 54, b"\x00\x01\x00\x00\x07\x01\x01\x00", 12), Corrupt, "present but declares no layers"),
    "trailing": (edited(MINIMAL, 72, b"\x00", 0), Corrupt, "trailing bytes after last chunk"),
    "unreferenced": (edited(EMPTY_CHUNK, 37, b"\x01\x01\0\0", 1), Corrupt, "is never referenced"),
    "not_minimal_width": (edited(edited(MINIMAL, 55, b"\x02\x00\x01\x02" + bytes(8192), 3), 17, b"\x00"), Corrupt, "non-minimal index width"),
    "refs_order": (edited(MINIMAL, 55, b"\x02\x01\x01\x01" + bytes(4096), 3), Corrupt, "references are not strictly ascending"),
    "unused": (edited(MINIMAL, 55, b"\x02\x00\x01\x01" + bytes(4096), 3), Corrupt, "is never used by the indices"),
    "index_range": (edited(MINIMAL, 55, b"\x02\x00\x01\x01" + b"\x01\x02" + bytes(4094), 3), Corrupt, "out of palette range"),
    "first_use": (edited(MINIMAL, 65, b"\x01"), Corrupt, "out of range"),
    "layers": (edited(MINIMAL, 64, b"\x80\x02", 1), Corrupt, "layer count 256 exceeds limit 255"),
    "stored_default": (edited(MINIMAL, 66, b"\x01\x00", 1), Corrupt, "must be omitted"),
    "override_zero": (edited(MINIMAL, 36, b"\x01\x00\0\0\0\0", 1), Corrupt, "override must not be zero"),
    "override_same": (edited(MINIMAL, 36, b"\x01\x00" + VERSION.to_bytes(4, "little"), 1), Corrupt, "equals the palette's own version"),
    "property_order": (edited(MINIMAL, 35, b"\x02\x01b\x00\x00\x01a\x00\x00", 1), Corrupt, "state properties must ascend"),
    "structure_flag": (edited(MINIMAL, 6, b"\x01"), Corrupt, "not valid for a structure"),
}


@pytest.mark.parametrize("name", NEGATIVE)
def test_refusals(name):
    data, kind, fragment = NEGATIVE[name]
    with pytest.raises(kind, match=fragment):
        (read_structure if data[6] == 1 else read_world)(data)


def body_edit(w: World, change) -> bytes:
    return change(write_world(w, "none"))


def test_writer_refuses_and_orders():
    c = column(0, 0)
    w = World(VERSION, states(20), ["minecraft:plains", "minecraft:ocean"], [c, c])
    with pytest.raises(InvalidContent, match="duplicate chunk"):
        write_world(w)
    c2 = column(1, 0)
    c2.block_entities *= 2
    with pytest.raises(InvalidContent, match="two block entities"):
        write_world(World(VERSION, states(20), w.biomes, [c2]))
    flat = lambda x, ref: Column(x, 0, 0, [[Storage((ref,))]], [Storage((0,))])
    w = World(VERSION, [state("minecraft:stone", VERSION), state("minecraft:dirt", VERSION)], ["minecraft:plains"], [flat(0, 1), flat(1, 1), flat(2, 0)])
    assert [s.name for s in read_world(write_world(w)).states] == ["minecraft:dirt", "minecraft:stone"]
    air = World(VERSION, [state("minecraft:air", VERSION)], ["minecraft:plains"], [flat(0, 0)])
    back = read_world(write_world(air))
    assert back.states == [] and back.columns[0].sections == [[]]


def test_identity_laws():
    w = world(6)
    want = content_hash(w)
    back = read_world(write_world(w, "best", stats=True))
    assert content_hash(back) == want
    w.columns.reverse()
    assert content_hash(w) == want
    w.columns[0].light = [(bytes(2048), None)] + [None] * 3
    assert content_hash(w) == want and read_world(write_world(w)).columns[0].light is not None
    assert content_hash(read_world(write_world(w, skip_biomes=True))) != want
    assert write_world(w, "fast") == write_world(w, "fast")
    assert content_hash(read_world(write_indexed(w))) == want
    assert content_hash(read_world(write_indexed(w, "none"))) == want
    c = back.columns[0]
    assert [s.at(1, 2, 3) for s in c.sections[1]] is not None and nbt.get(nbt.decode(back.settings), "other", nbt.SHORT) == 3


def test_budget_is_distinct():
    empty = lambda i: Column(i % 64, i // 64, 0, [[]], [Storage((0,))])
    data = write_world(World(VERSION, [], ["minecraft:plains"], [empty(i) for i in range(2000)]))
    assert len(read_world(data, 4 << 20).columns) == 2000
    with pytest.raises(BudgetExceeded):
        read_world(data, 1 << 20)


def test_palette_widths():
    for n in (256, 257):
        pal = [state(f"minecraft:s{i}", VERSION) for i in range(n)]
        w = World(VERSION, pal, ["minecraft:plains"], [Column(0, 0, 0, [[Storage.of(np.arange(4096) % n)]], [Storage((0,))])])
        back = read_world(write_world(w, "none"))
        assert len(back.columns[0].sections[0][0].refs) == n
        assert back.states[back.columns[0].sections[0][0].at(0, 5, 0)].name == "minecraft:s5"


def test_hostile_input():
    data = write_world(world(2), "none")
    for n in range(0, len(data), 97):
        with pytest.raises(WorldError):
            read_world(data[:n])
    rng = random.Random(1)
    for _ in range(300):
        at = rng.randrange(16, len(data) - 44)
        try:
            read_world(resealed(data[:at] + bytes([rng.randrange(256)]) + data[at + 1 :]))
        except WorldError:
            pass


def test_primitives():
    assert [f"{hash64(x):016x}" for x in (b"", b"a", b"abc")] == ["ef46db3751d8e999", "d24ec4f1a98c6e5b", "44bc2cf5ad770999"]
    low, high = -(1 << 31), (1 << 31) - 1
    assert morton(low, low) == 0 and morton(high, high) == (1 << 64) - 1 and morton(low + 1, low + 1) == 3
    assert morton(-1, 0) < morton(0, 0) < morton(1, 0) < morton(0, 1) < morton(1, 1)
    for v in (0, 1, -1, 63, 64, -64, -65, (1 << 63) - 1, -(1 << 63)):
        assert Cursor(svarint(v)).svarint() == v
    for v in (0, 127, 128, (1 << 64) - 1):
        assert Cursor(uvarint(v)).uvarint() == v
    with pytest.raises(Corrupt):
        Cursor(b"\xff" * 10).uvarint()
    with pytest.raises(Corrupt):
        decompress(compress(bytes(1 << 20), "fast"), most=1000)


def test_nbt():
    assert nbt.encode({"k": (nbt.SHORT, 0x0102)}) == bytes.fromhex("0a000002 01006b 0201 00")
    root = {
        "b": (nbt.BYTE, 1), "i": (nbt.INT, 2), "l": (nbt.LONG, 3), "s": (nbt.STRING, "x"), "f": (nbt.LIST, (nbt.FLOAT, [1.5])), "ia": (nbt.INTS, [1, 2]),
        "ba": (nbt.BYTES, [1, -1]), "la": (nbt.LONGS, [9]), "e": (nbt.LIST, (nbt.END, [])), "c": (nbt.COMPOUND, {"z": (nbt.DOUBLE, 0.5)}),
    }
    data = nbt.encode(root)
    assert nbt.decode(data) == root and nbt.encode(nbt.decode(data)) == data and list(nbt.decode(data)) == sorted(root)
    assert nbt.get(root, "b", nbt.INT) is None and nbt.get(root, "b", nbt.BYTE) == 1
    unsorted = bytes.fromhex("0a0000 01010062 01 01010061 01 00".replace(" ", ""))
    with pytest.raises(Corrupt, match="compound keys must ascend"):
        nbt.decode(unsorted)
    assert list(nbt.decode(nbt.canonical(unsorted))) == ["a", "b"]
    with pytest.raises(Corrupt, match="duplicate compound key"):
        nbt.decode(bytes.fromhex("0a00000101006101010100610100"))
    with pytest.raises(Corrupt, match="root compound must be unnamed"):
        nbt.decode(bytes.fromhex("0a01006100"))
    with pytest.raises(Corrupt, match="INT, want LONG"):
        nbt.check_tags(nbt.encode({"time": (nbt.INT, 1)}), nbt.SETTINGS)
    deep = (nbt.LIST, (nbt.END, []))
    for _ in range(70):
        deep = (nbt.LIST, (nbt.LIST, [deep[1]]))
    with pytest.raises(InvalidContent):
        nbt.encode({"d": deep})
    known, extra = nbt.settings(nbt.encode({"name": (nbt.STRING, "n"), "zz": (nbt.BYTE, 1)}))
    assert known["name"] == "n" and known["time"] is None and extra == {"zz": (nbt.BYTE, 1)}
    assert nbt.decode(nbt.encode_settings(known, extra)) == {"name": (nbt.STRING, "n"), "zz": (nbt.BYTE, 1)}
    assert nbt.unwrap(nbt.wrap(b"\xff\x00", {"a": (nbt.INT, 1)}, "m"), "m") == (b"\xff\x00", {"a": (nbt.INT, 1)})
    assert nbt.unwrap(b"raw", "m") == (b"raw", {})


def test_log(tmp_path):
    path = str(tmp_path / "w")
    pal = [state("minecraft:stone", VERSION)]
    flat = lambda x, ref=0: Column(x, 0, 0, [[Storage((ref,))]], [Storage((0,))])
    log = IndexedLog.create(path, VERSION)
    for x in range(40):
        log.store(flat(x), pal, ["minecraft:plains"])
    assert log.checkpoint() and not log.checkpoint() and len(log.positions()) == 40
    log.store(flat(1, 1), pal + [state("minecraft:dirt", VERSION)], ["minecraft:plains"])
    assert log.delete(2, 0) and not log.delete(99, 99)
    assert (1, 0) in log and (2, 0) not in log and log.column(2, 0) is None
    log.checkpoint()
    again = IndexedLog(path, read_only=True)
    assert [s.name for s in again.states] == ["minecraft:stone", "minecraft:dirt"] and again.column(1, 0).sections[0][0].refs == (1,)
    with open(path, "ab") as f:
        f.write(b"\x51" * 37)
    torn = IndexedLog(path)
    assert len(torn.positions()) == 39
    for _ in range(6):
        for x in range(40):
            torn.store(flat(x), pal, ["minecraft:plains"])
        torn.checkpoint()
    before = content_hash(read_world(torn.data))
    assert torn.garbage_ratio() > 0.3
    size = len(torn.data)
    torn.compact()
    assert len(torn.data) < size and content_hash(read_world(torn.data)) == before and torn.garbage_ratio() < 0.05
    torn.set_meta(nbt.encode({"name": (nbt.STRING, "x")}), b"u")
    torn.close()
    assert IndexedFile(open(path, "rb").read()).user_data == b"u"
    with pytest.raises(InvalidContent):
        torn.set_meta(nbt.encode({"time": (nbt.INT, 1)}), b"")


def test_append_and_publish(tmp_path):
    path = str(tmp_path / "w")
    w = read_world(write_indexed(world(3)))
    publish(path, write_indexed(w))
    current = read_world(open(path, "rb").read())
    current.columns.pop()
    append_indexed(path, current)
    assert len(read_world(open(path, "rb").read()).columns) == 2
    current.user_data = b"other"
    with pytest.raises(InvalidContent):
        append_indexed(path, current)


def test_dictionary():
    w = world(40, 255)
    data = write_indexed(w)
    from voxquarry.codec.indexed import encode_record, first_seen

    states_, names, moved = first_seen(w)
    bodies = [encode_record(c, states_, names, False) for c in moved.columns]
    assert train_dictionary(bodies[:4]) is None
    made = train_dictionary([b"some record body with shared words %d" % i * 200 for i in range(64)])
    if made:
        assert content_hash(read_world(write_indexed(w, "default", made))) == content_hash(read_world(data))


def test_indexed_refusals():
    data = write_indexed(world(2), "none")
    with pytest.raises(Corrupt, match="not valid for an indexed"):
        IndexedFile(data[:8] + bytes([data[8] | 2]) + data[9:])
    for at in range(16, len(data) - 60, 501):
        broken = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
        with pytest.raises(WorldError):
            IndexedFile(broken).whole()


def test_structures():
    pal = states(4)
    rng = np.random.default_rng(1)
    size = (20, 5, 33)
    cells = [[Storage.of(rng.integers(0, 6, 4096))] for _ in range(cell_grid(size))]
    ent = nbt.encode({"Pos": (nbt.LIST, (nbt.FLOAT, [1.0, 2.0, 3.0])), "Yaw": (nbt.FLOAT, 10.0)})
    s = Structure(VERSION, pal, size, (0, -3, 7), cells, [(1, 2, 3, nbt.encode({"id": (nbt.STRING, "Chest")}))], [ent], b"u")
    data = write_structure(s, "none")
    back = read_structure(data)
    assert back.size == size and back.origin == (0, -3, 7) and write_structure(back, "none") == data
    assert content_hash(back) == content_hash(read_structure(write_structure(s, "best")))
    with pytest.raises(BudgetExceeded):
        read_structure(data, 100)
    s.block_entities = [(30, 0, 0, b"")]
    with pytest.raises(InvalidContent):
        write_structure(s)
