"""Block states as column expressions: name, sorted properties, version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AIR = "minecraft:air"


def render(name: Column, props: Column, version: Column) -> Column:
    """``name[k=v,...]@version``; props are structs (key, type, int_val, str_val) sorted by key."""
    shown = F.transform(props, lambda p: F.concat(p["key"], F.lit("="), F.coalesce(p["str_val"], p["int_val"].cast("string"))))
    inner = F.when(F.size(props) > 0, F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))).otherwise("")
    return F.concat(name, inner, F.lit("@"), version.cast("string"))


def is_air(name: Column, props: Column) -> Column:
    return (name == AIR) & (F.size(props) == 0)


def bare_name(name: Column) -> Column:
    """What follows the namespace."""
    return F.substring_index(name, ":", -1)


def namespaced(name: Column) -> Column:
    return F.contains(name, F.lit(":"))
