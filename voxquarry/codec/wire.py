"""Primitive encodings: integers, varints, strings, blobs, bitsets, hashes, frames of zstandard."""

from __future__ import annotations

import struct

import xxhash
import zstandard

from .limits import MAX_BLOB, MAX_BODY, MAX_STRING, MAX_WINDOW, Corrupt, InvalidContent

_U64 = (1 << 64) - 1


def hash64(*parts: bytes) -> int:
    """xxHash64 with seed 0 of the parts one after another."""
    h = xxhash.xxh64(seed=0)
    for p in parts:
        h.update(p)
    return h.intdigest()


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


class Cursor:
    """Reads from bytes and refuses what isn't there or isn't minimal."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise Corrupt(f"{n} bytes wanted where {self.left} remain")
        self.at += n
        return self.data[self.at - n : self.at]

    def fixed(self, code: str):
        size = struct.calcsize("<" + code)
        return struct.unpack("<" + code, self.take(size))[0]

    def uvarint(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            if shift == 63 and b > 1:
                raise Corrupt("uvarint overflows 64 bits")
            out |= (b & 127) << shift
            if b < 128:
                if not b and shift:
                    raise Corrupt("non-minimal uvarint")
                return out
            shift += 7

    def svarint(self) -> int:
        v = self.uvarint()
        return (v >> 1) ^ -(v & 1)

    def count(self, most: int, what: str) -> int:
        n = self.uvarint()
        if n > most:
            raise Corrupt(f"{what} count {n} exceeds limit {most}")
        return n

    def string(self) -> str:
        raw = self.take(self.count(MAX_STRING, "string byte"))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            raise Corrupt("string is not valid UTF-8") from None

    def blob(self) -> bytes:
        return self.take(self.count(MAX_BLOB, "blob byte"))

    def bitset(self, n: int) -> list[int]:
        """Positions of the set bits."""
        bits = int.from_bytes(self.take((n + 7) // 8), "little")
        if bits >> n:
            raise Corrupt("non-zero padding bits in bitset")
        return [i for i in range(n) if bits >> i & 1] if bits else []

    def done(self, what: str) -> None:
        if self.left:
            raise Corrupt(f"{self.left} trailing bytes {what}")


def uvarint(v: int) -> bytes:
    if not 0 <= v <= _U64:
        raise InvalidContent(f"{v} doesn't fit an unsigned 64-bit integer")
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def svarint(v: int) -> bytes:
    return uvarint((v << 1 if v >= 0 else (-v << 1) - 1) & _U64)


def string(v: str) -> bytes:
    raw = v.encode("utf-8")
    if len(raw) > MAX_STRING:
        raise InvalidContent(f"string of {len(raw)} bytes, limit {MAX_STRING}")
    return uvarint(len(raw)) + raw


def blob(v: bytes) -> bytes:
    if len(v) > MAX_BLOB:
        raise InvalidContent(f"blob of {len(v)} bytes, limit {MAX_BLOB}")
    return uvarint(len(v)) + v


def bitset(n: int, present) -> bytes:
    bits = 0
    for i in present:
        bits |= 1 << i
    return bits.to_bytes((n + 7) // 8, "little")


#: Compression settings by name, as zstandard levels.
LEVELS = {"none": None, "fast": 1, "default": 3, "best": 19}


def compress(raw: bytes, level: str, dictionary: bytes | None = None, threads: int = 0) -> bytes:
    if LEVELS[level] is None:
        return raw
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    params = zstandard.ZstdCompressionParameters.from_level(LEVELS[level], window_log=min(23, max(10, (max(len(raw), 1)).bit_length())), write_checksum=1, threads=threads)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(raw)


def decompress(stored: bytes, most: int = MAX_BODY, dictionary: bytes | None = None) -> bytes:
    """One whole frame with a bounded window and a bounded result."""
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    out = bytearray()
    try:
        if zstandard.get_frame_parameters(stored).window_size > MAX_WINDOW and zstandard.frame_content_size(stored) > MAX_WINDOW:
            raise Corrupt("zstandard window exceeds the limit")
        decoder = zstandard.ZstdDecompressor(dict_data=d, max_window_size=MAX_WINDOW).decompressobj()
        view = memoryview(stored)
        for a in range(0, len(view), 1 << 16):
            out += decoder.decompress(view[a : a + (1 << 16)])
            if len(out) > most:
                raise Corrupt(f"decompressed data exceeds {most} bytes")
        if not decoder.eof or decoder.unused_data:
            raise Corrupt("the data is not one whole zstandard frame")
    except zstandard.ZstdError as e:
        raise Corrupt(f"zstandard: {e}") from None
    return bytes(out)
