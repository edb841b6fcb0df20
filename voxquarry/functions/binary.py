"""Functions on the format's byte strings, as Arrow-batched UDFs.

Only what bytes need is here; everything a column expression can say is in the
other modules of this package.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.codec import nbt, wire
from voxquarry.codec.limits import WorldError
from voxquarry.codec.model import unique_id, with_position, without_position
from voxquarry.codec.parts import synthetic_id
from voxquarry.sources.rows import PROPS, SETTINGS, state_of


def _each(fn, returns: T.DataType):
    """A UDF that maps non-null values one by one within an Arrow batch."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(bytes(v)))

    return F.pandas_udf(run, returns)


xxh64 = _each(lambda v: wire.signed(wire.hash64(v)), T.LongType())
xxh64_hex = _each(lambda v: f"{wire.hash64(v):016x}", T.StringType())
nbt_to_json = _each(nbt.to_json, T.StringType())
nbt_canonical = _each(nbt.canonical, T.BinaryType())
nbt_unique_id = _each(unique_id, T.LongType())
nbt_without_position = _each(without_position, T.BinaryType())


def _error(data: bytes) -> str | None:
    try:
        nbt.validate(data)
    except WorldError as e:
        return f"{type(e).__name__}: {e}"
    return None


nbt_error = _each(_error, T.StringType())


@F.pandas_udf(T.BinaryType())
def uvarint(values: pd.Series) -> pd.Series:
    """Minimal LEB128 of a long taken as unsigned."""
    return values.map(lambda v: None if pd.isna(v) else wire.uvarint(int(v) & (1 << 64) - 1))


@F.pandas_udf(T.BinaryType())
def svarint(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else wire.svarint(int(v)))


@F.pandas_udf(T.LongType())
def from_uvarint(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else wire.signed(wire.Cursor(bytes(v)).uvarint()))


@F.pandas_udf(T.BinaryType())
def nbt_with_position(data: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([with_position(bytes(d), int(a), int(b), int(c)) for d, a, b, c in zip(data, x, y, z)])


@F.pandas_udf(T.LongType())
def entity_id(x: pd.Series, z: pd.Series, i: pd.Series) -> pd.Series:
    """Id of an entity that carries none."""
    return pd.Series([synthetic_id(int(a), int(b), int(c)) for a, b, c in zip(x, z, i)])


@F.pandas_udf(T.BinaryType())
def nbt_pair(key: pd.Series, number: pd.Series, text: pd.Series) -> pd.Series:
    """A compound with an int ``k`` and a string under ``key``, for building test payloads."""
    return pd.Series([nbt.encode({"k": (nbt.INT, int(n)), k: (nbt.STRING, t)}) for k, n, t in zip(key, number, text)])


@F.pandas_udf(T.BinaryType())
def state_entry(states: pd.DataFrame) -> pd.Series:
    """Encoded palette entry of structs (name, props, version): the palette's sort key after the counts."""
    return pd.Series([state_of(s.name_, s.props, s.version).entry() for s in states.rename(columns={"name": "name_"}).itertuples(index=False)])


def settings(column):
    """Known settings of a compound as a struct; null where a key is missing."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nbt.settings(bytes(v) if v is not None else b"")[0] for v in values], columns=list(nbt.SETTINGS), dtype=object)

    return F.pandas_udf(run, SETTINGS)(column)


__all__ = ["PROPS", "entity_id", "nbt_error", "settings", "state_entry", "svarint", "uvarint", "xxh64"]
