"""Morton (Z-order) keys and the format's coordinate algebra, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks that spread 32 bits to the even places of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
LONG_MIN = -(1 << 63)


def spread(v: Column) -> Column:
    """Bit i of a number under 2**32 at place 2i."""
    v = v.cast("bigint")
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, z: Column) -> Column:
    """64-bit key of signed 32-bit coordinates, as an unsigned number in a signed long."""

    def unsigned(c):
        return (c.cast("bigint") + F.lit(1 << 31)).bitwiseAND(F.lit(0xFFFFFFFF))

    return spread(unsigned(x)).bitwiseOR(F.shiftleft(spread(unsigned(z)), 1))


def unsigned_order(key: Column) -> Column:
    """A signed long that sorts as ``key`` does unsigned."""
    return key.bitwiseXOR(F.lit(LONG_MIN))


def cluster(df: DataFrame, x: str, z: str, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted along the curve."""
    key = unsigned_order(morton(F.col(x), F.col(z)))
    keyed = df.withColumn("_z", key)
    ranged = keyed.repartitionByRange(partitions, "_z") if partitions else keyed.repartitionByRange("_z")
    return ranged.sortWithinPartitions("_z").drop("_z")


def floor_section(v: Column) -> Column:
    """Section or chunk of an absolute coordinate; floors, unlike integer division."""
    return F.shiftright(v, 4)


def local_index(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(x.bitwiseAND(F.lit(15)), 8).bitwiseOR(F.shiftleft(z.bitwiseAND(F.lit(15)), 4)).bitwiseOR(y.bitwiseAND(F.lit(15)))


def chunk_key(x: Column, z: Column) -> Column:
    return F.shiftleft(x.cast("bigint"), 32).bitwiseOR(z.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def chunk_key_x(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


def chunk_key_z(key: Column) -> Column:
    return F.shiftright(F.shiftleft(key, 32), 32).cast("int")


def pack_xz(x: Column, z: Column) -> Column:
    return x.bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(z.bitwiseAND(F.lit(15)), 4))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_length(v: Column) -> Column:
    """Bytes of the minimal LEB128 encoding of a number taken as unsigned."""
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(F.shiftrightunsigned(v, 7 * n) == 0, F.lit(n)).otherwise(out)
    return out.cast("int")
