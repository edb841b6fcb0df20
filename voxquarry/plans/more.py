"""Further operators as queries: blob joins, bitsets, maps, exports, logs and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxquarry.functions.flags import bit_at
from voxquarry.operators import overlay, voxels, zorder
from voxquarry.operators.log import VersionedTable
from voxquarry.plans.registry import register, table
from voxquarry.plans.worlds import CELLS, blocks
from voxquarry.sources.scratch import folder


@register("blob_join", """
    WITH b AS (SELECT text, min(doc_id) AS p FROM documents GROUP BY text), t AS (SELECT text, row_number() OVER (ORDER BY p) - 1 AS id FROM b)
    SELECT doc_id, CAST(length(t.text) AS INTEGER) AS size FROM documents JOIN t USING (text)
""")
def blob_join(spark, d):
    """References resolved against a blob table."""
    from voxquarry.operators.ordered import first_use_ids

    docs = table(spark, d, "documents").select("doc_id", "text")
    keyed = docs.withColumn("blob", F.sha2("text", 256))
    ids = first_use_ids(keyed.select("doc_id", "blob"), "blob", "doc_id").select("blob", "blob_id")
    blobs = keyed.groupBy("blob").agg(F.any_value(F.length("text")).alias("size")).join(ids, "blob").select("blob_id", "size")
    refs = keyed.select("doc_id", "blob").join(ids, "blob").select("doc_id", "blob_id")
    return refs.join(blobs, "blob_id").select("doc_id", "size")


@register("bitset_bits", "SELECT doc_id, i FROM (SELECT doc_id, i, CAST('0x' || substr(sha256(text), 2 * (i // 8) + 1, 2) AS INTEGER) AS b FROM documents, (SELECT unnest(range(0, 256))::INTEGER AS i)) WHERE (b >> (i % 8)) & 1 = 1")
def bitset_bits(spark, d):
    """Positions of the set bits of a presence bitset."""
    rows = table(spark, d, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    return rows.filter(bit_at(F.col("bits"), F.col("i")) == 1).select("doc_id", "i")


@register("map_ops", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS k, event_type AS kind, 2 AS keys FROM events")
def map_ops(spark, d):
    """Compound maps: with a key, without one, keys sorted bytewise."""
    m = F.from_json("props", "map<string,int>")
    changed = F.map_concat(F.map_filter(m, lambda k, v: k != "k"), F.create_map(F.lit("k"), m["k"] + 1))
    rows = table(spark, d, "events").select("event_id", changed.alias("m"), "event_type")
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("event_type").alias("kind"), (F.size(F.array_sort(F.map_keys("m"))) + 1).alias("keys"))


@register("block_entity_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def block_entity_filter(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").filter((F.col("event_type") == "click") & (F.try_variant_get(v, "$.k", "int") >= 50)).select("event_id", "user_id")


@register("user_data_update", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN upper(c_name) ELSE c_name END AS user_data FROM customer")
def user_data_update(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("user_data"))
    return overlay.merge(base, base.filter("c_custkey % 11 = 0").withColumn("user_data", F.upper("user_data")), ["c_custkey"])


def _box(spark, d):
    """All blocks as (world_id, x, y, z, layer, state_ref) and a palette."""
    cells = blocks(spark, d).withColumn("ref", F.ascii(F.substring("state", 1, 1)) * 256 + F.ascii(F.substring("state", 2, 1)))
    flat = cells.select(F.lit("s").alias("world_id"), "x", "y", "z", F.lit(0).alias("layer"), F.col("ref").cast("int").alias("state_ref"))
    palette = cells.select(F.lit("s").alias("world_id"), F.col("ref").cast("int").alias("ref"), F.col("state").alias("name")).distinct()
    return flat, palette


BOX = f"SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, state FROM ({CELLS})"


@register("export_single_layer", f"""
    WITH c AS ({BOX}), f AS (SELECT state, min((z, y, x)) AS p FROM c GROUP BY 1), i AS (SELECT state, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS id FROM f)
    SELECT x, y, z, id FROM c JOIN i USING (state)
""")
def export_single_layer(spark, d):
    flat, palette = _box(spark, d)
    return voxels.export_single_layer(flat, palette).select("x", "y", "z", "id")


@register("export_layers", f"SELECT x * 16 * 32 + y * 32 + z AS flat, ascii(state) * 256 + ascii(substr(state, 2)) AS block, -1 AS extra FROM ({BOX})")
def export_layers(spark, d):
    flat, _ = _box(spark, d)
    return voxels.export_layers(flat, (64, 16, 32)).select("flat", "block", "extra")


@register("biome_election", """
    WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS names FROM lineitem GROUP BY 1),
         u AS (SELECT unnest(names) AS name, len(names) = 1 AS alone FROM g), n AS (SELECT name, count(*) AS uses, count(*) FILTER (WHERE alone) AS uniform FROM u GROUP BY 1),
         r AS (SELECT *, row_number() OVER (ORDER BY uses DESC, name) AS ref FROM n)
    SELECT name, uniform FROM r WHERE uniform > 0 ORDER BY uniform DESC, ref LIMIT 1
""")
def biome_election(spark, d):
    """The default biome of a world: most uniform sections, ties to the lowest final reference."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.ascii("l_returnflag").alias("ref"), F.col("l_returnflag").alias("name"))
    sections = items.groupBy("l_orderkey").agg(F.collect_set("ref").alias("palette")).select(F.lit("w").alias("world_id"), "palette")
    palette = items.select(F.lit("w").alias("world_id"), "ref", "name").distinct()
    return voxels.biome_election(sections, palette).select("name", "uniform")


@register("zorder_cluster", "SELECT o_orderkey, o_custkey FROM orders")
def zorder_cluster(spark, d):
    """Rows laid out along the curve; the rows stay the same."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return zorder.cluster(rows.withColumns({"x": F.col("o_custkey").cast("int"), "z": F.col("o_orderkey").cast("int")}), "x", "z").drop("x", "z")


@register("zorder_layout", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS out_of_place FROM orders")
def zorder_layout(spark, d):
    """The layout as written: rows that lie out of their place on the curve, inside a file and from file to file."""
    top = folder(spark, "layout")
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("int").alias("x"), F.col("o_orderkey").cast("int").alias("z"))
    zorder.cluster(rows, "x", "z", int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(top)
    key = zorder.unsigned_order(zorder.morton(F.col("x"), F.col("z")))
    lying = spark.read.parquet(top).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), key.alias("key"))
    behind = (F.lag("key").over(W.partitionBy("file").orderBy("at")) > F.col("key")).cast("bigint")
    files = lying.withColumn("behind", behind).groupBy("file").agg(F.count("*").alias("n"), F.coalesce(F.sum("behind"), F.lit(0)).alias("behind"), F.min("key").alias("low"), F.max("key").alias("high"))
    before = F.coalesce((F.lag("high").over(W.orderBy("file")) > F.col("low")).cast("bigint"), F.lit(0))  # a row for each file
    return files.select("n", (F.col("behind") + before).alias("out")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("out"), F.lit(0)).alias("out_of_place"))


@register("log_versions", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'second' WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment END AS v
    FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0
""")
def log_versions(spark, d):
    """A versioned table: two upserts and a deletion between them, compacted and read."""
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    t = VersionedTable.create(spark, folder(spark, "log"), ["c_custkey"], base)
    t.upsert(base.filter("c_custkey % 3 = 0").withColumn("v", F.lit("first")))
    t.delete(base.filter("c_custkey % 7 = 0"))
    t.checkpoint()
    t.upsert(base.filter("c_custkey % 5 = 0").withColumn("v", F.lit("second")))
    t.checkpoint()
    t.compact()
    return t.read()


@register("log_stream", """
    SELECT user_id, event_type AS v FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1
""")
def log_stream(spark, d):
    """Events streamed into a versioned table, the last of a user winning."""
    from voxquarry.streaming import log_stream as streams

    top = folder(spark, "stream")
    rows = table(spark, d, "events")
    rows.repartition(3).write.parquet(f"{top}/in")  # a stream reads folders
    t = VersionedTable.create(spark, f"{top}/table", ["user_id"], rows.select("user_id", F.col("event_type").alias("v")).limit(0))
    changes = spark.readStream.schema(rows.schema).parquet(f"{top}/in").select("user_id", F.col("event_type").alias("v"), "event_id")
    streams.start(changes, t, ["event_id"], f"{top}/checkpoint").awaitTermination()
    return t.read()
