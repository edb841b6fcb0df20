"""Box fills, rotation, clipping and per-column reductions of voxel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rings of property values, each followed by the next on a quarter turn
#: (x, z) -> (size_z - 1 - z, x), for properties that hold text and for those that hold numbers.
TEXT_RINGS = {
    "minecraft:cardinal_direction": ("north", "east", "south", "west"),
    "minecraft:block_face": ("north", "east", "south", "west"),
    "facing": ("north", "east", "south", "west"),
    "minecraft:facing_direction": ("north", "east", "south", "west"),
    "pillar_axis": ("x", "z"),
}
NUMBER_RINGS = {
    "facing_direction": (2, 5, 3, 4),
    "direction": (0, 1, 2, 3),
    "weirdo_direction": (0, 2, 1, 3),
}
SIGN_RING, SIGN_STEP = ("ground_sign_direction", 16), 4


def turned(key: str, value, turns: int = 1):
    """A property's value after ``turns`` quarter turns; what no rule names stays."""
    if key == SIGN_RING[0] and isinstance(value, int):
        return (value + SIGN_STEP * turns) % SIGN_RING[1] if 0 <= value < SIGN_RING[1] else value
    ring = (TEXT_RINGS if isinstance(value, str) else NUMBER_RINGS).get(key, ())
    return ring[(ring.index(value) + turns) % len(ring)] if value in ring else value


def span(a: Column, b: Column) -> Column:
    """Inclusive range between two corners given in any order."""
    return F.sequence(F.least(a, b), F.greatest(a, b))


def fill_boxes(boxes: DataFrame, order: str, value: str) -> DataFrame:
    """(x, y, z, value) of all cells of the boxes (x1..z2); where boxes overlap, the last in ``order`` wins.

    Boxes expand by ``explode``, one axis at a time, and overlaps resolve with an
    aggregate that combines before the shuffle.
    """
    cells = boxes
    for axis in "xyz":
        cells = cells.withColumn(axis, F.explode(span(F.col(f"{axis}1"), F.col(f"{axis}2"))))
    return cells.groupBy("x", "y", "z").agg(F.max_by(value, order).alias(value))


def rotate_position(x: Column, z: Column, size_x, size_z, turns: int) -> tuple[Column, Column]:
    """Cell after ``turns`` quarter turns of a box."""
    for _ in range(turns % 4):
        x, z = F.lit(size_z) - 1 - z, x
        size_x, size_z = size_z, size_x
    return x, z


def rotate_entity(x: Column, z: Column, yaw: Column, size_z: float) -> tuple[Column, Column, Column]:
    """Free position and heading after one quarter turn; 32-bit floats stay 32-bit."""
    heading = F.pmod(yaw + F.lit(90).cast("float"), F.lit(360).cast("float"))
    return (F.lit(size_z).cast("float") - z).cast("float"), x, heading.cast("float")


def turn_table(spark, turns: int = 1) -> DataFrame:
    """(key, numeric, value, turned) with values as text, for joining with properties."""
    pairs = [(k, False, v) for k, ring in TEXT_RINGS.items() for v in ring]
    pairs += [(k, True, v) for k, ring in NUMBER_RINGS.items() for v in ring] + [(SIGN_RING[0], True, v) for v in range(SIGN_RING[1])]
    return spark.createDataFrame([(k, n, str(v), str(turned(k, v, turns))) for k, n, v in pairs], "key string, numeric boolean, value string, turned string")


def rotate_properties(props: DataFrame, turns: int = 1) -> DataFrame:
    """Properties (..., key, numeric, value) with values turned; what isn't in the table stays."""
    steps = turn_table(props.sparkSession, turns)  # under a hundred rows, whatever the data
    return props.join(F.broadcast(steps), ["key", "numeric", "value"], "left").withColumn("value", F.coalesce("turned", "value")).drop("turned")


def inside(x: Column, y: Column, z: Column, size: tuple[int, int, int]) -> Column:
    return (x >= 0) & (x < size[0]) & (y >= 0) & (y < size[1]) & (z >= 0) & (z < size[2])


def flat_index(x: Column, y: Column, z: Column, size_y, size_z) -> Column:
    """Position of a cell in export order (x, y, z)."""
    return x * size_y * size_z + y * size_z + z


def height_map(voxels: DataFrame, x: str, z: str, y: str, solid: Column) -> DataFrame:
    """Topmost solid y of every column."""
    return voxels.filter(solid).groupBy(x, z).agg(F.max(y).alias("top"))
