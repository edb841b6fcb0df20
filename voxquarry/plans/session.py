"""A session over worlds: read filters, skipped parts, overlays, instances, saving.

Filters act on reading only: a column that a filter hides is neither absent nor
dropped from a save.  Changes go to an overlay that each session owns; the base
tables are shared and never written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.codec.limits import InvalidContent
from voxquarry.operators import overlay
from voxquarry.sources import sinks
from voxquarry.sources.rows import SCHEMAS
from voxquarry.sources.world_source import tables

#: Key of each table's rows for overlays.
KEYS = {
    "worlds": ["world_id"], "block_palette": ["world_id", "ref"], "biome_palette": ["world_id", "ref"], "columns": ["world_id", "x", "z"],
    "sections": ["world_id", "x", "z"], "biome_sections": ["world_id", "x", "z"], "light": ["world_id", "x", "z"],
    "entities": ["world_id", "chunk_x", "chunk_z"], "block_entities": ["world_id", "x", "y", "z"], "scheduled_updates": ["world_id", "x", "y", "z"],
}
#: Tables whose rows belong to a column of a world, and its position from theirs.
PLACES = {
    "columns": ("x", "z"), "sections": ("x", "z"), "biome_sections": ("x", "z"), "light": ("x", "z"), "entities": ("chunk_x", "chunk_z"),
    "block_entities": ("x >> 4", "z >> 4"), "scheduled_updates": ("x >> 4", "z >> 4"),
}
SKIPPABLE = {"entities", "block_entities", "scheduled_updates", "biome_sections", "light"}


@dataclass
class Options:
    """What a session shows: predicates over columns, entities and block entities, and parts to leave out."""

    read_only: bool = False
    filter_column: Column | str | None = None
    filter_entity: Column | str | None = None
    filter_block_entity: Column | str | None = None
    skip: set[str] = field(default_factory=set)
    skip_user_data: bool = False
    budget: int | None = None

    def __post_init__(self):
        if self.skip - SKIPPABLE:
            raise ValueError(f"can't skip {sorted(self.skip - SKIPPABLE)}")


def _of_columns(df: DataFrame, name: str, columns: DataFrame, how: str) -> DataFrame:
    """Rows of table ``name`` that lie in ``columns`` (world_id, x, z), or with ``left_anti`` the others."""
    x, z = PLACES[name]
    keys = columns.select(F.col("world_id").alias("_w"), F.col("x").alias("_cx"), F.col("z").alias("_cz"))
    placed = df.withColumns({"_x": F.expr(x), "_z": F.expr(z)})
    return placed.join(keys, (F.col("world_id") == F.col("_w")) & (F.col("_x") == F.col("_cx")) & (F.col("_z") == F.col("_cz")), how).drop("_x", "_z")


class Session:
    """Tables of the worlds at a path, with an overlay on top."""

    def __init__(self, spark: SparkSession, base: dict[str, DataFrame], options: Options | None = None):
        self.spark, self.base, self.options = spark, base, options or Options()
        self.changes: dict[str, tuple[DataFrame | None, DataFrame | None]] = {}
        #: Columns that were removed with all that was in them then.
        self.emptied: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> "Session":
        more = {"budget": str(options.budget)} if options and options.budget else {}
        return cls(spark, tables(spark, path, **more), options)

    @classmethod
    def empty(cls, spark: SparkSession) -> "Session":
        return cls(spark, {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    def instance(self) -> "Session":
        """Another session over the same base, with an overlay of its own."""
        return Session(self.spark, self.base, self.options)

    def _writable(self) -> None:
        if self.options.read_only:
            raise InvalidContent("the session is read-only")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows that replace those of their key (all sections of a column at once)."""
        self._writable()
        old_rows, old_gone = self.changes.get(name, (None, None))
        key = KEYS[name]
        merged = rows if old_rows is None else overlay.merge(old_rows, rows, key)
        gone = rows.select(*key).distinct()
        self.changes[name] = (merged, gone if old_gone is None else old_gone.unionByName(gone).distinct())

    def remove(self, name: str, keys: DataFrame) -> None:
        """Remove the rows of these keys; with a column goes everything in it."""
        self._writable()
        if name == "columns":
            gone = keys.select(*KEYS[name]).distinct()
            for part, (rows, hidden) in self.changes.items():
                if part in PLACES and part != name and rows is not None:
                    self.changes[part] = (_of_columns(rows, part, gone, "left_anti"), hidden)
            self.emptied = gone if self.emptied is None else self.emptied.unionByName(gone).distinct()
        key = KEYS[name]
        rows, gone = self.changes.get(name, (None, None))
        hidden = keys.select(*key).distinct()
        self.changes[name] = (None if rows is None else overlay.delete(rows, hidden, key), hidden if gone is None else gone.unionByName(hidden).distinct())

    def merged(self, name: str) -> DataFrame:
        """Base and overlay without filters: what a save writes."""
        base = self.base[name]
        rows, gone = self.changes.get(name, (None, None))
        if gone is not None:
            base = overlay.delete(base, gone, KEYS[name])
        if self.emptied is not None and name in PLACES and name != "columns":
            base = _of_columns(base, name, self.emptied, "left_anti")
        return base if rows is None else base.unionByName(rows.select(*base.columns))

    def table(self, name: str) -> DataFrame:
        """What a reader sees."""
        o = self.options
        df = self.merged(name)
        if name in o.skip:
            return df.limit(0)
        if name == "entities" and o.filter_entity is not None:
            df = df.filter(o.filter_entity)
        if name == "block_entities" and o.filter_block_entity is not None:
            df = df.filter(o.filter_block_entity)
        if o.skip_user_data and "user_data" in df.columns:
            df = df.withColumn("user_data", F.lit(b""))
        if o.filter_column is not None and name in PLACES:
            df = df.filter(o.filter_column) if name == "columns" else _of_columns(df, name, self.table("columns"), "left_semi")
        return df

    def exists(self, world_id: str, x: int, z: int) -> bool:
        """Whether a reader finds the column."""
        here = (F.col("world_id") == world_id) & (F.col("x") == x) & (F.col("z") == z)
        return not self.table("columns").filter(here).isEmpty()

    def populated(self) -> DataFrame:
        """(world_id, x, z, populated) of every column that a reader finds: whether any of its sections holds a block."""
        used = self.table("sections").join(self.air(), "world_id", "left")
        solid = F.exists("palette", lambda r: ~F.array_contains("air", r))
        held = used.withColumn("air", F.coalesce("air", F.array().cast("array<int>"))).filter(solid).select("world_id", "x", "z").distinct()
        return self.table("columns").select("world_id", "x", "z").join(held.withColumn("populated", F.lit(True)), ["world_id", "x", "z"], "left").fillna(False)

    def air(self) -> DataFrame:
        """(world_id, air): the references that stand for air."""
        return self.table("block_palette").filter("name = 'minecraft:air'").groupBy("world_id").agg(F.collect_set("ref").alias("air"))

    def put_if_absent(self, rows: dict[str, DataFrame]) -> DataFrame:
        """Add the columns that aren't there yet, with their parts; the keys of those that were added.

        ``rows`` has ``columns`` and the tables of what is in them.  A column that a
        filter hides is there all the same, and so is not replaced.
        """
        self._writable()
        new = rows["columns"].join(self.merged("columns").select(*KEYS["columns"]), KEYS["columns"], "left_anti")
        keys = new.select(*KEYS["columns"])
        for name, df in rows.items():
            self.upsert(name, new if name == "columns" else _of_columns(df, name, keys, "left_semi"))
        return keys

    def load(self, keys: DataFrame, generate) -> DataFrame:
        """Sections of the columns ``keys`` (world_id, x, z); missing ones come from ``generate`` (a function of their keys) and are kept."""
        missing = keys.select(*KEYS["columns"]).distinct().join(self.merged("columns").select(*KEYS["columns"]), KEYS["columns"], "left_anti")
        self.put_if_absent(generate(missing))
        return _of_columns(self.table("sections"), "sections", keys, "left_semi")

    def column(self, world_id: str, x: int, z: int) -> DataFrame:
        """Sections of one column."""
        return self.table("sections").filter((F.col("world_id") == world_id) & (F.col("x") == x) & (F.col("z") == z))

    def save(self, folder: str, mode: str | None = None, **options) -> "Session":
        """Write all worlds with their changes and go on from what was written; a solid world becomes an indexed one with ``mode``.

        The files of the base are left as they are: a save is a new folder, so that a
        failed one leaves nothing half written.
        """
        self._writable()
        self.save_as(folder, mode or "solid", **options).collect()  # a row for each world
        return Session.open(self.spark, folder, self.options)

    def save_as(self, folder: str, mode: str = "solid", **options) -> DataFrame:
        """Write every world with its changes; filters don't apply."""
        merged = {n: self.merged(n) for n in KEYS}
        return sinks.write_worlds(sinks.from_read(merged), folder, mode, **options)

    def compacted(self) -> "Session":
        """What the filters show, as a base of its own: the destructive form."""
        return Session(self.spark, {n: self.table(n) for n in KEYS}, Options(read_only=self.options.read_only))
