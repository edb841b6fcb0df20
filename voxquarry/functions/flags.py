"""Header flags, bit tests and nibble arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_LIGHT, STATS, DEFAULT_BIOME, UNCOMPRESSED = 1, 2, 8, 16
REF_MASK = 0xFFFF0000
KNOWN = STORE_LIGHT | STATS | DEFAULT_BIOME | UNCOMPRESSED | REF_MASK


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) == bit


def default_ref(flags: Column) -> Column:
    return F.shiftright(flags, 16).bitwiseAND(F.lit(0xFFFF))


def flag_columns(flags: Column, ref_of: Column | None = None) -> list[Column]:
    """Meaning of a header's flags; ``ref_of`` may give the flags for the reference alone."""
    wide = flags.cast("bigint")
    return [
        has(wide, STORE_LIGHT).alias("store_light"), has(wide, STATS).alias("stats"), has(wide, DEFAULT_BIOME).alias("default_biome"),
        has(wide, UNCOMPRESSED).alias("uncompressed"), default_ref(wide if ref_of is None else ref_of).alias("default_ref"),
        (wide.bitwiseAND(F.lit(~KNOWN)) != 0).alias("unknown"),
    ]


def byte_at(data: Column, i: Column) -> Column:
    """Unsigned byte of a binary; position from 0."""
    return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")


def bit_at(bits: Column, i: Column) -> Column:
    """Bit of a bitset, lowest bit of a byte first."""
    return F.bit_get(byte_at(bits, F.shiftright(i, 3)), i.bitwiseAND(F.lit(7)))


def nibble(data: Column, i: Column) -> Column:
    """4-bit value i of an array, even ones in the low half of a byte."""
    byte = byte_at(data, F.shiftright(i, 1))
    return F.when(i % 2 == 0, byte.bitwiseAND(F.lit(15))).otherwise(F.shiftright(byte, 4))
