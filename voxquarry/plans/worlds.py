"""Queries that go through world files: built from plain tables, written, scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.functions import binary
from voxquarry.operators import voxels
from voxquarry.plans.registry import register, table
from voxquarry.sources import sinks
from voxquarry.sources.rows import SCHEMAS
from voxquarry.sources.scratch import folder
from voxquarry.sources.world_source import register as register_source

VERSION = 18040335
# A block for each (part, supplier, line) cell: the greatest flag and status that lands there.
CELLS = """
    SELECT l_partkey & 63 AS x, CAST(l_linenumber AS BIGINT) AS y, l_suppkey & 31 AS z, max(l_returnflag || l_linestatus) AS state
    FROM lineitem GROUP BY 1, 2, 3
"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, z, state) cells."""
    rows = table(spark, d, "lineitem").select(
        F.expr("CAST(l_partkey & 63 AS INT)").alias("x"), F.col("l_linenumber").alias("y"), F.expr("CAST(l_suppkey & 31 AS INT)").alias("z"),
        F.concat("l_returnflag", "l_linestatus").alias("state"),
    )
    return rows.groupBy("x", "y", "z").agg(F.max("state").alias("state"))


def world_tables(spark: SparkSession, d: str) -> sinks.WorldTables:
    """A world of these blocks: sections, palettes, a column for each chunk, biomes by region."""
    top = folder(spark, "cells")
    blocks(spark, d).write.parquet(top)  # read by each of the tables below
    cells = spark.read.parquet(top).withColumn("world_id", F.lit("overworld"))
    names = cells.groupBy("state").count().select("state")
    from voxquarry.operators.palette import ranked

    refs = ranked(names, F.col("state")).select("state", (F.col("ref") + 1).cast("int").alias("ref"))
    placed = cells.join(refs, "state").select("world_id", "x", "y", "z", F.col("ref").alias("state_ref"))
    sections = voxels.build_sections(placed)
    props = F.array().cast("array<struct<key:string,type:tinyint,int_val:int,str_val:string>>")
    air = spark.range(1).select(F.lit("air").alias("state"), F.lit(0).alias("ref"))
    palette = refs.unionByName(air).select(
        F.lit("overworld").alias("world_id"), "ref", F.concat(F.lit("minecraft:"), F.lower("state")).alias("name"), props.alias("props"), F.lit(VERSION).alias("version")
    )
    entry = binary.state_entry(F.struct("name", "props", "version"))
    palette = palette.withColumn("entry", entry)
    chunks = placed.select("world_id", F.shiftright("x", 4).alias("x"), F.shiftright("z", 4).alias("z")).distinct()
    columns = chunks.select("world_id", "x", "z", F.lit(None).cast("bigint").alias("morton"), F.lit(0).alias("min_section"), F.lit(1).alias("section_count"), F.lit(0).cast("bigint").alias("tick"), F.lit(b"").alias("user_data"))
    biomes = spark.range(2).select(F.lit("overworld").alias("world_id"), F.col("id").cast("int").alias("ref"), F.when(F.col("id") == 0, "minecraft:plains").otherwise("minecraft:ocean").alias("name"))
    biome_sections = chunks.select("world_id", "x", "z", F.lit(0).alias("section_y"), F.array((F.col("x") % 2).cast("int")).alias("palette"), F.lit(None).cast("binary").alias("indices"))
    worlds = spark.createDataFrame([("overworld", "world", "solid", 0, VERSION, b"", None, None, b"", None)], SCHEMAS["worlds"])
    return sinks.WorldTables(worlds, palette, biomes, columns, sections, biome_sections)


def written(spark: SparkSession, d: str, mode: str, name: str, **options) -> DataFrame:
    """A table of that world, scanned from the file it was written to."""
    top = folder(spark, "worlds")
    sinks.write_worlds(world_tables(spark, d), top, mode=mode, stats=True).collect()  # one row: the file's name and hash
    register_source(spark)
    return spark.read.format("voxelworld").options(path=top, table=name, **options).load()


@register("world_solid_scan", f"SELECT 'minecraft:' || lower(state) AS name, count(*) AS cells FROM ({CELLS}) GROUP BY 1")
def world_solid_scan(spark, d):
    """Cells of each state in a solid file."""
    top = folder(spark, "worlds")
    sinks.write_worlds(world_tables(spark, d), top, stats=True).collect()
    register_source(spark)
    read = lambda name: spark.read.format("voxelworld").options(path=top, table=name).load()
    counts = voxels.state_counts(read("sections"))
    named = counts.join(read("block_palette").select("world_id", F.col("ref").alias("state_ref"), "name"), ["world_id", "state_ref"])
    return named.filter("name <> 'minecraft:air'").select("name", "cells")


@register("world_indexed_scan", f"SELECT CAST(x >> 4 AS INTEGER) AS x, CAST(z >> 4 AS INTEGER) AS z, CAST(0 AS INTEGER) AS min_section FROM ({CELLS}) GROUP BY 1, 2")
def world_indexed_scan(spark, d):
    """Columns of an indexed file, read in slices of its directory."""
    return written(spark, d, "indexed", "columns", columns_per_task="2").select("x", "z", "min_section")


@register("world_point_read", f"SELECT x, z, y, state FROM (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, 'minecraft:' || lower(state) AS state FROM ({CELLS})) WHERE x >> 4 = 1 AND z >> 4 = 0")
def world_point_read(spark, d):
    """One column's cells by its key, which is pushed into the reader: no other record is decoded."""
    top = folder(spark, "worlds")
    sinks.write_worlds(world_tables(spark, d), top, mode="indexed").collect()
    register_source(spark)
    read = lambda name: spark.read.format("voxelworld").options(path=top, table=name).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pruned = spark.read.format("voxelworld").options(path=top, table="sections", pushdown="true", columns_per_task="1").load()
    cells = voxels.voxels(pruned.filter("x = 1 AND z = 0"))
    named = cells.join(read("block_palette").select(F.col("ref").alias("state_ref"), F.col("name").alias("state")), "state_ref")
    return named.filter("state <> 'minecraft:air'").select("x", "z", "y", "state")


@register("world_meta_scan", f"SELECT CAST(18040335 AS INTEGER) AS block_version, count(DISTINCT (x >> 4, z >> 4)) AS chunks, count(DISTINCT state) + 1 AS states, CAST(2 AS BIGINT) AS biomes FROM ({CELLS})")
def world_meta_scan(spark, d):
    """Header and statistics; no record is decoded."""
    meta = written(spark, d, "solid", "worlds")
    return meta.select("block_version", F.col("stats.chunks").alias("chunks"), F.col("stats.blockStates").alias("states"), F.col("stats.biomes").alias("biomes"))


@register("world_palette_scan", f"""
    SELECT 'minecraft:' || lower(state) AS name FROM ({CELLS}) GROUP BY 1 UNION ALL SELECT 'minecraft:air'
""")
def world_palette_scan(spark, d):
    return written(spark, d, "solid", "block_palette").select("name")


@register("world_biome_scan", f"SELECT CAST(x >> 4 AS INTEGER) AS x, CAST(z >> 4 AS INTEGER) AS z, CASE WHEN (x >> 4) % 2 = 0 THEN 'minecraft:plains' ELSE 'minecraft:ocean' END AS biome FROM ({CELLS}) GROUP BY 1, 2, 3")
def world_biome_scan(spark, d):
    """Biomes after elision on writing and filling on reading."""
    top = folder(spark, "worlds")
    sinks.write_worlds(world_tables(spark, d), top).collect()
    register_source(spark)
    read = lambda name: spark.read.format("voxelworld").options(path=top, table=name).load()
    flat = read("biome_sections").select("x", "z", F.element_at("palette", 1).alias("ref"))
    return flat.join(read("biome_palette").select("ref", F.col("name").alias("biome")), "ref").select("x", "z", "biome")


@register("world_height_map", f"SELECT CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, CAST(max(y) AS INTEGER) AS top FROM ({CELLS}) GROUP BY 1, 2")
def world_height_map(spark, d):
    """Topmost solid cell of every column, from the built sections."""
    cells = voxels.voxels(voxels.build_sections(blocks(spark, d).select(F.lit("w").alias("world_id"), "x", "y", "z", F.lit(1).alias("state_ref"))))
    return voxels.height_map(cells, [0]).select("x", "z", "top")


@register("nbt_functions", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS kind, CAST(1 AS BOOLEAN) AS valid
    FROM events
""")
def nbt_functions(spark, d):
    """Compounds made, validated and queried through their JSON view."""
    e = table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("n"))
    made = e.withColumn("nbt", binary.nbt_pair(F.lit("kind"), "n", "event_type"))
    view = F.parse_json(binary.nbt_to_json("nbt"))
    return made.select("event_id", F.try_variant_get(view, "$.k", "int").alias("k"), F.try_variant_get(view, "$.kind", "string").alias("kind"), binary.nbt_error("nbt").isNull().alias("valid"))


@register("varint_bytes", """
    SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 16384 THEN printf('%02X%02X', (o_orderkey & 127) | 128, o_orderkey >> 7)
           ELSE printf('%02X%02X%02X', (o_orderkey & 127) | 128, ((o_orderkey >> 7) & 127) | 128, o_orderkey >> 14) END AS hex
    FROM orders
""")
def varint_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.hex(binary.uvarint("o_orderkey")).alias("hex"))


@register("state_entries", "SELECT p_partkey, upper(to_hex(encode(chr(length('minecraft:' || lower(p_brand)::VARCHAR)::INTEGER))) || to_hex(encode('minecraft:' || lower(p_brand)))) || '00' AS hex FROM part")
def state_entries(spark, d):
    """Encoded palette entries: the length-prefixed name and no property."""
    props = F.array().cast("array<struct<key:string,type:tinyint,int_val:int,str_val:string>>")
    named = table(spark, d, "part").select("p_partkey", F.struct(F.concat(F.lit("minecraft:"), F.lower("p_brand")).alias("name"), props.alias("props"), F.lit(VERSION).alias("version")).alias("s"))
    return named.select("p_partkey", F.hex(binary.state_entry("s")).alias("hex"))


@register("content_hashes")
def content_hashes(spark, d):
    """Content hash of the built world in either mode: one value."""
    t = world_tables(spark, d)
    solid = sinks.write_worlds(t, folder(spark, "worlds"))
    log = sinks.write_worlds(t, folder(spark, "worlds"), mode="indexed")
    return solid.unionByName(log).groupBy("content_hash").agg(F.count("*").alias("files"))


@register("hash64")
def hash64(spark, d):
    """xxHash64 with seed 0 of every text (no SQL engine here has it)."""
    return table(spark, d, "documents").select("doc_id", binary.xxh64(F.encode("text", "UTF-8")).alias("h"))
