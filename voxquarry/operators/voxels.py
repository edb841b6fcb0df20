"""Section tables: voxel views, counts, palettes, rotation and exports.

Counting works on the compact form wherever it can; only views that want a row
per cell expand it, inside Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 4096


def _cells(palette: list[int], indices: bytes | None) -> np.ndarray:
    if indices is None:
        return np.full(CELLS, palette[0], np.int32)
    return np.array(palette, np.int32)[np.frombuffer(indices, dtype="<u2")]


_I = np.arange(CELLS, dtype=np.int32)
_X, _Z, _Y = _I >> 8, (_I >> 4) & 15, _I & 15


def voxels(sections: DataFrame) -> DataFrame:
    """(world_id, x, y, z, layer, state_ref): a row for each cell of the sections."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("world_id", "x", "z", "section_y", "layer", "palette", "indices")))
            for world, cx, cz, cy, layer, palette, indices in rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([world] * CELLS, pa.string()), pa.array(_X + cx * 16), pa.array(_Y + cy * 16), pa.array(_Z + cz * 16),
                        pa.array(np.full(CELLS, layer, np.int32)), pa.array(_cells(palette, indices)),
                    ],
                    names=["world_id", "x", "y", "z", "layer", "state_ref"],
                )

    return sections.select("world_id", "x", "z", "section_y", "layer", "palette", "indices").mapInArrow(
        run, "world_id string, x int, y int, z int, layer int, state_ref int"
    )


def state_counts(sections: DataFrame) -> DataFrame:
    """(world_id, state_ref, cells): cells of each state, counted per section before any shuffle."""

    def run(batches):
        for batch in batches:
            out: dict[tuple, int] = {}
            for world, palette, indices in zip(*(batch[c].to_pylist() for c in ("world_id", "palette", "indices"))):
                n = np.bincount(np.frombuffer(indices, dtype="<u2"), minlength=len(palette)) if indices is not None else [CELLS]
                for ref, k in zip(palette, n):
                    out[world, ref] = out.get((world, ref), 0) + int(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())],
                names=["world_id", "state_ref", "cells"],
            )

    partial = sections.select("world_id", "palette", "indices").mapInArrow(run, "world_id string, state_ref int, cells bigint")
    return partial.groupBy("world_id", "state_ref").agg(F.sum("cells").alias("cells"))


def trimmed(sections: DataFrame, block_palette: DataFrame, place: str = "section_y") -> DataFrame:
    """Sections without trailing all-air layers; inner air layers stay.

    The palette joins the sections' palettes, not their cells.
    """
    air = block_palette.filter((F.col("name") == "minecraft:air") & (F.size("props") == 0)).select("world_id", F.col("ref").alias("_air"))
    airs = air.groupBy("world_id").agg(F.collect_set("_air").alias("_airs"))
    marked = sections.join(airs, "world_id", "left").withColumn("_solid", F.size(F.array_except("palette", F.coalesce("_airs", F.array().cast("array<int>")))) > 0)
    keep = F.max(F.when(F.col("_solid"), F.col("layer"))).over(W.partitionBy("world_id", "x", "z", place))
    return marked.withColumn("_keep", keep).filter(F.col("layer") <= F.col("_keep")).drop("_airs", "_solid", "_keep")


def reference_counts(sections: DataFrame, updates: DataFrame) -> DataFrame:
    """(world_id, ref, uses): local palettes that name a state, plus scheduled updates of it."""
    named = sections.select("world_id", F.explode(F.array_distinct("palette")).alias("ref"))
    return named.unionByName(updates.select("world_id", F.col("state_ref").alias("ref"))).groupBy("world_id", "ref").agg(F.count("*").alias("uses"))


def canonical_refs(block_palette: DataFrame, uses: DataFrame) -> DataFrame:
    """(world_id, ref, new_ref): canonical order of the palette entries in use."""
    order = W.partitionBy("world_id").orderBy(F.desc("uses"), "entry", "version")
    used = block_palette.join(uses, ["world_id", "ref"])
    return used.select("world_id", "ref", (F.row_number().over(order) - 1).cast("int").alias("new_ref"))


def biome_election(biome_sections: DataFrame, biome_palette: DataFrame) -> DataFrame:
    """(world_id, name, uniform): the default biome of each world, by uniform sections, ties by canonical order."""
    flat = biome_sections.select("world_id", F.explode(F.array_distinct("palette")).alias("ref"), (F.size("palette") == 1).alias("alone"))
    counts = flat.groupBy("world_id", "ref").agg(F.count("*").alias("uses"), F.count_if("alone").alias("uniform")).join(biome_palette, ["world_id", "ref"])
    ranked = counts.withColumn("new_ref", F.row_number().over(W.partitionBy("world_id").orderBy(F.desc("uses"), "name")) - 1).filter("uniform > 0")
    best = F.min(F.struct((-F.col("uniform")).alias("a"), F.col("new_ref").alias("b"), F.col("name").alias("name"))).alias("w")
    won = ranked.groupBy("world_id").agg(best)
    return won.filter("w.b < 65536").select("world_id", F.col("w.name").alias("name"), (-F.col("w.a")).alias("uniform"))


def height_map(cells: DataFrame, air_refs) -> DataFrame:
    """(world_id, x, z, top): topmost cell that isn't air; ``cells`` is a voxel view."""
    return cells.filter(~F.col("state_ref").isin(list(air_refs))).groupBy("world_id", "x", "z").agg(F.max("y").alias("top"))


def rotated_cells(cells: DataFrame, size: tuple[int, int, int], turns: int = 1) -> DataFrame:
    """A structure's voxel view after quarter turns."""
    from .space import rotate_position

    x, z = rotate_position(F.col("x"), F.col("z"), size[0], size[2], turns)
    return cells.withColumns({"x": x.cast("int"), "z": z.cast("int")})


def structure_voxels(cells: DataFrame, structures: DataFrame) -> DataFrame:
    """(world_id, x, y, z, layer, state_ref) inside each structure's box."""
    grid = structures.select("world_id", "size", ((F.element_at("size", 2) + 15) / 16).cast("int").alias("gy"), ((F.element_at("size", 3) + 15) / 16).cast("int").alias("gz"))
    placed = cells.join(grid, "world_id").select(
        "world_id", F.expr("cell div (gz * gy)").cast("int").alias("x"), F.expr("(cell div gy) % gz").cast("int").alias("z"), F.expr("cell % gy").cast("int").alias("section_y"),
        "layer", "palette", "indices",
    )
    flat = voxels(placed).join(grid, "world_id")
    return flat.filter((F.col("x") < F.element_at("size", 1)) & (F.col("y") < F.element_at("size", 2)) & (F.col("z") < F.element_at("size", 3))).drop("size", "gy", "gz")


def export_single_layer(cells: DataFrame, palette_rows: DataFrame) -> DataFrame:
    """Layer 0 in (z, y, x) order with a first-seen dictionary; 0 stands for absent, at most 255 states."""
    named = cells.filter("layer = 0").join(palette_rows.select("world_id", F.col("ref").alias("state_ref"), "name"), ["world_id", "state_ref"])
    order = F.struct("z", "y", "x")
    firsts = named.filter("name <> 'minecraft:air'").groupBy("world_id", "name").agg(F.min(order).alias("first"))
    ids = firsts.withColumn("id", F.row_number().over(W.partitionBy("world_id").orderBy("first"))).drop("first")
    checked = ids.withColumn("id", F.when(F.col("id") > 255, F.raise_error(F.lit("more than 255 states"))).otherwise(F.col("id")).cast("int"))
    return named.join(checked, ["world_id", "name"], "left").select("world_id", "x", "y", "z", F.coalesce("id", F.lit(0)).alias("id"))


def export_layers(cells: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """(world_id, flat, block, extra) in (x, y, z) order; -1 where a layer holds nothing."""
    from .space import flat_index

    flat = flat_index(F.col("x"), F.col("y"), F.col("z"), size[1], size[2])
    one = lambda n: F.coalesce(F.max(F.when(F.col("layer") == n, F.col("state_ref"))), F.lit(-1))
    return cells.withColumn("flat", flat).groupBy("world_id", "flat").agg(one(0).alias("block"), one(1).alias("extra"))


def build_sections(blocks: DataFrame, air: int = 0) -> DataFrame:
    """Sections from block rows (world_id, x, y, z, state_ref[, layer]); unset cells are air.

    Cells are gathered per section after a local combine; a section has at most 4096 of them.
    """
    rows = blocks if "layer" in blocks.columns else blocks.withColumn("layer", F.lit(0))
    local = F.shiftleft(F.col("x").bitwiseAND(F.lit(15)), 8).bitwiseOR(F.shiftleft(F.col("z").bitwiseAND(F.lit(15)), 4)).bitwiseOR(F.col("y").bitwiseAND(F.lit(15)))
    keyed = rows.select(
        "world_id", F.shiftright("x", 4).alias("x"), F.shiftright("z", 4).alias("z"), F.shiftright("y", 4).alias("section_y"), "layer",
        F.struct(local.alias("i"), F.col("state_ref").alias("s")).alias("cell"),
    )
    groups = keyed.groupBy("world_id", "x", "z", "section_y", "layer").agg(F.collect_list("cell").alias("cells"))

    def run(batches):
        for batch in batches:
            palettes, indices = [], []
            for cells in batch["cells"].to_pylist():
                full = np.full(CELLS, air, np.int64)
                full[[c["i"] for c in cells]] = [c["s"] for c in cells]
                values, inverse = np.unique(full, return_inverse=True)
                palettes.append(values.astype(np.int32).tolist())
                indices.append(None if len(values) == 1 else inverse.astype("<u2").tobytes())
            keep = [batch[c] for c in ("world_id", "x", "z", "section_y", "layer")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(palettes, pa.list_(pa.int32())), pa.array(indices, pa.binary())], names=["world_id", "x", "z", "section_y", "layer", "palette", "indices"]
            )

    return groups.mapInArrow(run, "world_id string, x int, z int, section_y int, layer int, palette array<int>, indices binary")
