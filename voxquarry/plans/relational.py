"""The engine's relational operators as queries over plain tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxquarry.operators import constraints, ordered, overlay, palette, space, zorder
from voxquarry.plans.registry import register, table

STATE = "l_returnflag || '|' || l_linestatus"
RANKED = f"""
    SELECT CAST(row_number() OVER (ORDER BY uses DESC, state) - 1 AS BIGINT) AS ref, state, uses
    FROM (SELECT {STATE} AS state, count(*) AS uses FROM lineitem GROUP BY 1)
"""


def _states(spark, d):
    return table(spark, d, "lineitem").withColumn("state", F.concat_ws("|", "l_returnflag", "l_linestatus"))


@register("palette_encode", f"SELECT l_orderkey, l_linenumber, l_partkey, ref FROM lineitem JOIN ({RANKED}) ON state = {STATE}")
def palette_encode(spark, d):
    rows = _states(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "state")
    return palette.encode(rows, palette.canonical_palette(rows, "state"), "state")


@register("palette_decode", f"SELECT l_orderkey, l_linenumber, l_partkey, {STATE} AS state FROM lineitem")
def palette_decode(spark, d):
    """Reference to entry lookup; must give back what was encoded."""
    rows = _states(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "state")
    entries = palette.canonical_palette(rows, "state")
    return palette.encode(rows, entries, "state").join(entries, "ref").select("l_orderkey", "l_linenumber", "l_partkey", "state")


@register("palette_remap", f"""
    WITH r AS ({RANKED}), f AS (
        SELECT CAST(row_number() OVER (ORDER BY p, state) - 1 AS BIGINT) AS old_ref, state
        FROM (SELECT {STATE} AS state, min(l_orderkey) AS p FROM lineitem GROUP BY 1))
    SELECT old_ref, ref FROM f JOIN r USING (state)
""")
def palette_remap(spark, d):
    """First-seen references joined to canonical ones."""
    rows = _states(spark, d).select("l_orderkey", "state")
    old = palette.first_seen_palette(rows, "state", "l_orderkey").select(F.col("ref").alias("old_ref"), "state")
    return old.join(palette.canonical_palette(rows, "state"), "state").select("old_ref", "ref")


@register("palette_first_seen", """
    SELECT CAST(row_number() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS ref, event_type, first_pos
    FROM (SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1)
""")
def palette_first_seen(spark, d):
    return palette.first_seen_palette(table(spark, d, "events"), "event_type", "event_id")


@register("palette_segments", """
    WITH a AS (SELECT p_type AS state, min(p_partkey) AS p FROM part WHERE p_partkey <= 20 GROUP BY 1),
         ar AS (SELECT CAST(row_number() OVER (ORDER BY p, state) - 1 AS BIGINT) AS ref, state FROM a),
         b AS (SELECT p_type AS state, min(p_partkey) AS p FROM part WHERE p_partkey > 20 AND p_type NOT IN (SELECT state FROM ar) GROUP BY 1)
    SELECT ref, state FROM ar
    UNION ALL SELECT CAST((SELECT count(*) FROM ar) + row_number() OVER (ORDER BY p, state) - 1 AS BIGINT), state FROM b
""")
def palette_segments(spark, d):
    """A palette that grows by a second segment; references already given stay."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("state"), "p_partkey")
    first = palette.first_seen_palette(rows.filter("p_partkey <= 20"), "state", "p_partkey").select("ref", "state")
    return palette.grow(first, rows.filter("p_partkey > 20"), "state", "p_partkey")


@register("palette_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def palette_semi(spark, d):
    refs = table(spark, d, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return palette.used(table(spark, d, "customer").select("c_custkey", "c_name"), refs, "c_custkey")


@register("palette_orphans", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def palette_orphans(spark, d):
    refs = table(spark, d, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return palette.orphans(table(spark, d, "customer").select("c_custkey", "c_name"), refs, "c_custkey")


@register("palette_cross_segment", "SELECT DISTINCT p_type AS state FROM part WHERE p_partkey <= 20 INTERSECT SELECT p_type FROM part WHERE p_partkey > 20")
def palette_cross_segment(spark, d):
    """Entries that two segments both declare: a file with any is refused."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("state"), "p_partkey")
    return rows.filter("p_partkey <= 20").select("state").intersect(rows.filter("p_partkey > 20").select("state"))


@register("palette_equality", """
    WITH a AS (SELECT p_type FROM part WHERE p_size < 25), b AS (SELECT p_type FROM part WHERE p_size >= 25)
    SELECT (SELECT count(*) FROM (SELECT p_type FROM a EXCEPT SELECT p_type FROM b)) AS only_old,
           (SELECT count(*) FROM (SELECT p_type FROM b EXCEPT SELECT p_type FROM a)) AS only_new
""")
def palette_equality(spark, d):
    """An append's precondition: neither palette holds what the other lacks."""
    rows = table(spark, d, "part")
    a = rows.filter("p_size < 25").select("p_type").distinct()
    b = rows.filter("p_size >= 25").select("p_type").distinct()
    sides = a.withColumn("old", F.lit(1)).join(b.withColumn("new", F.lit(1)), "p_type", "full")
    return sides.agg(F.count_if(F.col("new").isNull()).alias("only_old"), F.count_if(F.col("old").isNull()).alias("only_new"))


@register("version_override", """
    SELECT p_partkey, coalesce(v.version, 18040335) AS version
    FROM part LEFT JOIN (SELECT p_partkey AS k, CAST(p_size + 1000 AS INTEGER) AS version FROM part WHERE p_size % 7 = 0) v ON p_partkey = k
""")
def version_override(spark, d):
    part = table(spark, d, "part")
    overrides = part.filter("p_size % 7 = 0").select("p_partkey", (F.col("p_size") + 1000).cast("int").alias("version"))
    return palette.with_overrides(part.select("p_partkey"), overrides, "p_partkey", "version", F.lit(18040335))


ELECT = """
    SELECT c_nationkey, c_mktsegment, n AS votes FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r
        FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE r = 1
"""


@register("default_elect", ELECT)
def default_elect(spark, d):
    return palette.elect_default(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@register("default_elide", f"SELECT c_custkey, c_nationkey, c.c_mktsegment FROM customer c JOIN ({ELECT}) e USING (c_nationkey) WHERE c.c_mktsegment <> e.c_mktsegment")
def default_elide(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return palette.elide_default(rows, palette.elect_default(rows, ["c_nationkey"], "c_mktsegment"), ["c_nationkey"], "c_mktsegment")


@register("default_fill", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def default_fill(spark, d):
    """Elision undone: the default where a row was left out."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    defaults = palette.elect_default(rows, ["c_nationkey"], "c_mktsegment")
    kept = palette.elide_default(rows, defaults, ["c_nationkey"], "c_mktsegment")
    return palette.fill_default(rows.select("c_custkey", "c_nationkey"), kept, defaults, ["c_custkey"], ["c_nationkey"], "c_mktsegment")


@register("uniform_groups", """
    SELECT l_returnflag, count(*) AS uses, count(*) FILTER (WHERE kinds = 1) AS uniform
    FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)
    JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY 1
""")
def uniform_groups(spark, d):
    """How many local palettes an entry appears in, and in how many it is alone."""
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("kinds"))
    flat = groups.select(F.size("kinds").alias("n"), F.explode("kinds").alias("l_returnflag"))
    return flat.groupBy("l_returnflag").agg(F.count("*").alias("uses"), F.count_if(F.col("n") == 1).alias("uniform"))


@register("dedup_blobs", "SELECT min(doc_id) AS first_doc, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY text")
def dedup_blobs(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).select("first_doc", "copies", "digest")


@register("first_use_ids", """
    SELECT doc_id, CAST(b.blob_id AS BIGINT) AS blob_id FROM documents JOIN (
        SELECT text, row_number() OVER (ORDER BY p) - 1 AS blob_id FROM (SELECT text, min(doc_id) AS p FROM documents GROUP BY text)) b USING (text)
""")
def first_use_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("blob"))
    return docs.join(ordered.first_use_ids(docs, "blob", "doc_id"), "blob").select("doc_id", "blob_id")


@register("first_use_check", """
    WITH u AS (SELECT event_id, CAST(user_id AS BIGINT) AS ident FROM events)
    SELECT event_id, ident, known_max FROM (
        SELECT *, coalesce(max(ident) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS known_max FROM u)
    WHERE ident > known_max + 1
""")
def first_use_check(spark, d):
    """References that skip an id (user ids aren't numbered by first use, so some do)."""
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("bigint").alias("ident"))
    return ordered.first_use_violations(rows, "event_id", "ident")


def _spread16(c: str) -> str:
    out = f"CAST({c} AS BIGINT)"
    for s, m in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = f"(({out} | ({out} << {s})) & {m})"
    return out


@register("morton_sort", f"""
    SELECT o_orderkey, m AS morton, CAST(row_number() OVER (ORDER BY m, o_orderkey) - 1 AS BIGINT) AS place FROM (
        SELECT o_orderkey, {_spread16('(o_custkey & 65535)')} | ({_spread16('(o_orderkey & 65535)')} << 1) AS m FROM orders)
""")
def morton_sort(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", zorder.spread(F.expr("o_custkey & 65535")).bitwiseOR(F.shiftleft(zorder.spread(F.expr("o_orderkey & 65535")), 1)).alias("morton"))
    keyed = rows.withColumn("_at", F.struct("morton", "o_orderkey"))
    inside = W.partitionBy("_stretch").orderBy("_at")
    # Stretches of the curve: 2**20 keys each; a row per stretch carries the counts over.
    cut = keyed.withColumn("_stretch", F.shiftright("morton", 20))
    sizes = cut.groupBy("_stretch").agg(F.count("*").alias("n"))
    before = sizes.select("_stretch", F.coalesce(F.sum("n").over(W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    placed = cut.withColumn("_r", F.row_number().over(inside)).join(before, "_stretch")
    return placed.select("o_orderkey", "morton", (F.col("b") + F.col("_r") - 1).cast("bigint").alias("place"))


@register("morton_order", """
    SELECT x, z, CAST((
        SELECT sum((((x + 2147483648) >> i) & 1)::HUGEINT << (2 * i)) + sum((((z + 2147483648) >> i) & 1)::HUGEINT << (2 * i + 1))
        FROM (SELECT unnest(range(0, 32))::INTEGER AS i)) AS VARCHAR) AS morton
    FROM (SELECT CAST(x AS BIGINT) AS x, CAST(z AS BIGINT) AS z FROM (VALUES (0, 0), (-1, 0), (1, 0), (0, 1), (1, 1), (-2147483648, -2147483648), (2147483647, 2147483647), (-17, 33)) t(x, z))
""")
def morton_order(spark, d):
    """Keys over the whole signed range, as unsigned numbers."""
    points = [(0, 0), (-1, 0), (1, 0), (0, 1), (1, 1), (-(1 << 31), -(1 << 31)), ((1 << 31) - 1, (1 << 31) - 1), (-17, 33)]
    key = zorder.morton(F.col("x"), F.col("z"))
    wrap = F.when(key < 0, F.lit("18446744073709551616")).otherwise(F.lit("0")).cast("decimal(21,0)")
    return spark.createDataFrame(points, "x long, z long").select("x", "z", (key.cast("decimal(20,0)") + wrap).cast("string").alias("morton"))


@register("delta_encode", "SELECT o_orderkey, o_custkey - coalesce(lag(o_custkey) OVER (ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta_encode(spark, d):
    return ordered.delta_encode(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "delta").select("o_orderkey", "delta")


@register("delta_decode", "SELECT o_orderkey, o_custkey FROM orders")
def delta_decode(spark, d):
    deltas = ordered.delta_encode(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "delta").select("o_orderkey", "delta")
    return ordered.delta_decode(deltas, "o_orderkey", "delta", "o_custkey").select("o_orderkey", "o_custkey")


@register("directory_deltas", """
    SELECT o_orderkey, x - lag(x, 1, 0) OVER w AS dx, z - lag(z, 1, 0) OVER w AS dz, pos - lag(pos, 1, 0) OVER w AS d_offset
    FROM (SELECT o_orderkey, o_custkey & 31 AS x, o_custkey >> 5 AS z, coalesce(sum(100 + o_custkey % 50) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM orders)
    WINDOW w AS (ORDER BY o_orderkey)
""")
def directory_deltas(spark, d):
    """Three-way delta coding of a directory: position and running file offset."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("o_custkey & 31").alias("x"), F.shiftright("o_custkey", 5).alias("z"), (100 + F.col("o_custkey") % 50).alias("len"))
    placed = ordered.running_sum(rows, "o_orderkey", "len", "end").withColumn("at", F.col("end") - F.col("len")).drop("len", "end")
    for value, out in (("x", "dx"), ("z", "dz"), ("at", "d_offset")):
        placed = ordered.delta_encode(placed, "o_orderkey", value, out)
    return placed.select("o_orderkey", "dx", "dz", "d_offset")


@register("override_deltas", "SELECT p_partkey, p_partkey - lag(p_partkey, 1, 0) OVER (ORDER BY p_partkey) AS index_delta FROM part WHERE p_size % 7 = 0")
def override_deltas(spark, d):
    rows = table(spark, d, "part").filter("p_size % 7 = 0").select("p_partkey", F.col("p_partkey").alias("at"))
    return ordered.delta_encode(rows, "p_partkey", "at", "index_delta").select("p_partkey", "index_delta")


@register("latest_wins", """
    SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def latest_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ordered.latest_wins(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


OVERLAY = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0"


@register("overlay_merge", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL {OVERLAY}")
def overlay_merge(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    dirty = base.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return overlay.merge(base, dirty, ["o_orderkey"])


@register("precedence_lookup", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders")
def precedence_lookup(spark, d):
    """Overlay before base before log."""
    o = table(spark, d, "orders")
    first = o.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("v"))
    second = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    third = o.select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return overlay.precedence_lookup(o.select("o_orderkey"), [first, second, third], ["o_orderkey"], "v")


@register("tombstone_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 <> 3")
def tombstone_delete(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return overlay.delete(base, base.filter("o_orderkey % 10 = 3"), ["o_orderkey"])


@register("log_apply", """
    WITH last AS (SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT c_custkey AS user_id, 0.0::DOUBLE AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)
    UNION ALL SELECT user_id, value FROM last WHERE event_type <> 'error'
""")
def log_apply(spark, d):
    """A base with a change log over it: last change of a key, deletions included."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0.0).alias("value"))
    log = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("gone"))
    return overlay.apply_log(base, log, ["user_id"], ["event_id"], "gone")


@register("branch_isolation", """
    SELECT 'a' AS branch, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS changed, count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 = 0) AS both FROM orders
    UNION ALL SELECT 'b', count(*), count(*) FILTER (WHERE o_orderkey % 7 = 0), count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 = 0) FROM orders
""")
def branch_isolation(spark, d):
    """Two branches over one base: neither sees the other's overlay."""
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    parts = []
    for name, step in (("a", 10), ("b", 7)):
        dirty = base.filter(F.col("o_orderkey") % step == 0).withColumn("o_orderstatus", F.lit(f"~{name}"))
        merged = overlay.merge(base, dirty, ["o_orderkey"])
        mine = F.col("o_orderstatus") == f"~{name}"
        parts.append(merged.agg(F.lit(name).alias("branch"), F.count("*").alias("n"), F.count_if(mine).alias("changed"), F.count_if(mine & (F.col("o_orderkey") % 70 == 0)).alias("both")))
    return parts[0].unionByName(parts[1])


@register("garbage_ratio", """
    SELECT sum(len) AS total, sum(len) FILTER (WHERE r > 1) AS garbage, CAST(sum(len) FILTER (WHERE r > 1) AS DOUBLE) / sum(len) AS ratio
    FROM (SELECT CAST(length(props) AS BIGINT) AS len, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
""")
def garbage_ratio(spark, d):
    """Bytes that later writes of the same key have superseded."""
    e = table(spark, d, "events").select("user_id", "event_id", F.length("props").cast("bigint").alias("len"))
    per_key = e.groupBy("user_id").agg(F.sum("len").alias("all"), F.max_by("len", "event_id").alias("live"))
    total, garbage = F.sum("all"), F.sum(F.col("all") - F.col("live"))
    return per_key.agg(total.alias("total"), garbage.alias("garbage"), (garbage.cast("double") / total).alias("ratio"))


@register("running_budget", """
    SELECT o_orderkey, spent, spent > 4000000 AS refused
    FROM (SELECT o_orderkey, CAST(sum(1024 + 128 * (o_custkey % 5)) OVER (ORDER BY o_orderkey) AS BIGINT) AS spent FROM orders)
""")
def running_budget(spark, d):
    """Running cost of decoding in file order, and where a budget refuses."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.lit(1024) + 128 * (F.col("o_custkey") % 5)).cast("bigint").alias("cost"))
    return ordered.running_sum(rows, "o_orderkey", "cost", "spent").select("o_orderkey", "spent", (F.col("spent") > 4_000_000).alias("refused"))


@register("constraint_unique", "SELECT 'unique' AS rule, l_orderkey || ',' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def constraint_unique(spark, d):
    return constraints.unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("constraint_ascent", """
    SELECT 'ascent' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_custkey || '<=' || b AS detail
    FROM (SELECT o_orderkey, o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders) WHERE o_custkey <= b
""")
def constraint_ascent(spark, d):
    return constraints.ascending(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@register("constraint_refint", "SELECT 'reference' AS rule, CAST(o_custkey AS VARCHAR) AS key, 'missing' AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def constraint_refint(spark, d):
    parent = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return constraints.references(table(spark, d, "orders").select("o_custkey"), parent, "o_custkey")


@register("constraint_range", "SELECT 'range' AS rule, CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS VARCHAR) AS detail FROM part WHERE p_size NOT BETWEEN 5 AND 40")
def constraint_range(spark, d):
    return constraints.in_range(table(spark, d, "part"), ["p_partkey"], "p_size", 5, 40)


@register("blob_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def blob_orphans(spark, d):
    """Stored contents that no record refers to."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("stride_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 16 = 0")
def stride_sample(spark, d):
    return ordered.stride_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 16)


@register("trim_trailing", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus FROM lineitem JOIN (
        SELECT l_orderkey AS k, max(l_linenumber) AS keep FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1) ON l_orderkey = k AND l_linenumber <= keep
""")
def trim_trailing(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return ordered.trim_trailing(rows, ["l_orderkey"], "l_linenumber", F.col("l_linestatus") != "O")


@register("row_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 60 AND o_orderkey % 2 = 0")
def row_filter(spark, d):
    return table(spark, d, "orders").filter("o_custkey BETWEEN 10 AND 60 AND o_orderkey % 2 = 0").select("o_orderkey", "o_custkey")


@register("json_filter", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 10")
def json_filter(spark, d):
    return table(spark, d, "events").filter(F.try_variant_get(F.try_parse_json("props"), "$.k", "int") < 10).select("event_id")


@register("typed_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def typed_get(spark, d):
    """Typed getters: null where a key is missing or of another type."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.nothing", "string").alias("absent"))


@register("projection_drop", "SELECT event_id, user_id FROM events")
def projection_drop(spark, d):
    return table(spark, d, "events").drop("ts", "event_type", "value", "props")


SIGNED = "SELECT o_orderkey, o_custkey - 75 AS x, o_orderkey % 1000 - 500 AS z FROM orders"


def _signed(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") - 75).alias("x"), (F.col("o_orderkey") % 1000 - 500).alias("z"))


@register("chunk_key", f"SELECT o_orderkey, CAST(x * 4294967296 + (CASE WHEN z < 0 THEN z + 4294967296 ELSE z END) AS BIGINT) AS chunk_key, CAST(x AS INTEGER) AS back_x, CAST(z AS INTEGER) AS back_z FROM ({SIGNED})")
def chunk_key(spark, d):
    keyed = _signed(spark, d).withColumn("chunk_key", zorder.chunk_key(F.col("x"), F.col("z")))
    return keyed.select("o_orderkey", "chunk_key", zorder.chunk_key_x(F.col("chunk_key")).alias("back_x"), zorder.chunk_key_z(F.col("chunk_key")).alias("back_z"))


@register("chunk_floor", f"SELECT o_orderkey, x >> 4 AS cx, x & 15 AS lx, z >> 4 AS cz, z & 15 AS lz FROM ({SIGNED})")
def chunk_floor(spark, d):
    fifteen = F.lit(15)
    return _signed(spark, d).select("o_orderkey", zorder.floor_section(F.col("x")).alias("cx"), F.col("x").bitwiseAND(fifteen).alias("lx"), zorder.floor_section(F.col("z")).alias("cz"), F.col("z").bitwiseAND(fifteen).alias("lz"))


@register("local_index", f"SELECT o_orderkey, ((x & 15) << 8) | ((z & 15) << 4) | (o_orderkey & 15) AS i, (x & 15) | ((z & 15) << 4) AS packed_xz FROM ({SIGNED})")
def local_index(spark, d):
    x, z = F.col("x"), F.col("z")
    return _signed(spark, d).select("o_orderkey", zorder.local_index(x, F.col("o_orderkey"), z).alias("i"), zorder.pack_xz(x, z).alias("packed_xz"))


@register("zigzag", f"SELECT o_orderkey, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS zx, CASE WHEN z >= 0 THEN 2 * z ELSE -2 * z - 1 END AS zz FROM ({SIGNED})")
def zigzag(spark, d):
    return _signed(spark, d).select("o_orderkey", zorder.zigzag(F.col("x")).alias("zx"), zorder.zigzag(F.col("z")).alias("zz"))


@register("varint_len", """
    SELECT o_orderkey, CAST(CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 WHEN v < 34359738368 THEN 5 ELSE 6 END AS INTEGER) AS n
    FROM (SELECT o_orderkey, o_orderkey * o_custkey * 997 AS v FROM orders)
""")
def varint_len(spark, d):
    return table(spark, d, "orders").select("o_orderkey", zorder.varint_length(F.col("o_orderkey") * F.col("o_custkey") * 997).alias("n"))


@register("index_width", """
    SELECT o_custkey, CAST(CASE WHEN n = 1 THEN 0 WHEN n <= 256 THEN 1 ELSE 2 END AS INTEGER) AS width, CAST(CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 8 THEN 3 WHEN n <= 16 THEN 4 WHEN n <= 32 THEN 5 ELSE 6 END AS INTEGER) AS bits
    FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
""")
def index_width(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"))
    bits = F.when(F.col("n") <= 2, 1).when(F.col("n") <= 4, 2).when(F.col("n") <= 8, 3).when(F.col("n") <= 16, 4).when(F.col("n") <= 32, 5).otherwise(6)
    return n.select("o_custkey", palette.index_width(F.col("n")).alias("width"), bits.cast("int").alias("bits"))


@register("flag_bits", """
    SELECT l_partkey, (l_partkey & 1) = 1 AS store_light, (l_partkey & 2) = 2 AS stats, (l_partkey & 8) = 8 AS default_biome, (l_partkey & 16) = 16 AS uncompressed,
           (l_partkey * 4099 >> 16) & 65535 AS default_ref, (l_partkey & ~(1 | 2 | 8 | 16 | 4294901760)) <> 0 AS unknown FROM lineitem
""")
def flag_bits(spark, d):
    from voxquarry.functions.flags import flag_columns

    return table(spark, d, "lineitem").select("l_partkey", *flag_columns(F.col("l_partkey"), ref_of=F.col("l_partkey") * 4099))


@register("light_nibbles", "SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN b & 15 ELSE b >> 4 END AS level FROM (SELECT doc_id, i, CAST('0x' || substr(sha256(text), 2 * (i // 2) + 1, 2) AS INTEGER) AS b FROM documents, (SELECT unnest(range(0, 64))::INTEGER AS i))")
def light_nibbles(spark, d):
    """4-bit values of a byte array, the even ones in the low half."""
    from voxquarry.functions.flags import nibble

    rows = table(spark, d, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("light"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select("doc_id", "i", nibble(F.col("light"), F.col("i")).alias("level"))


@register("state_render", "SELECT p_partkey, p_name || '[brand=' || p_brand || ',size=' || p_size || ']@18040335' AS state FROM part")
def state_render(spark, d):
    from voxquarry.functions.states import render

    props = F.array(
        F.struct(F.lit("brand").alias("key"), F.lit(2).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("int_val"), F.col("p_brand").alias("str_val")),
        F.struct(F.lit("size").alias("key"), F.lit(1).cast("tinyint").alias("type"), F.col("p_size").alias("int_val"), F.lit(None).cast("string").alias("str_val")),
    )
    return table(spark, d, "part").select("p_partkey", render(F.col("p_name"), props, F.lit(18040335)).alias("state"))


@register("stats_compound", """
    SELECT count(DISTINCT o_orderkey) AS chunks, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS "filledSections",
           (SELECT count(DISTINCT l_partkey) FROM lineitem) AS "uniqueBlobs", (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) AS "blockStates",
           (SELECT count(*) FROM nation) AS biomes FROM orders
""")
def stats_compound(spark, d):
    items = table(spark, d, "lineitem").agg(F.count_if(F.col("l_linestatus") == "F").alias("filledSections"), F.countDistinct("l_partkey").alias("uniqueBlobs"), F.countDistinct("l_returnflag", "l_linestatus").alias("blockStates"))
    chunks = table(spark, d, "orders").agg(F.countDistinct("o_orderkey").alias("chunks"))
    biomes = table(spark, d, "nation").agg(F.count("*").alias("biomes"))
    return chunks.crossJoin(items).crossJoin(biomes)  # one row each


@register("presence", "SELECT bool_or(l_discount > 0.09) AS any_light, max(l_linenumber) AS max_layer, CAST(sum(l_linenumber) AS BIGINT) AS storages FROM lineitem")
def presence(spark, d):
    return table(spark, d, "lineitem").agg(F.bool_or(F.col("l_discount") > 0.09).alias("any_light"), F.max("l_linenumber").alias("max_layer"), F.sum("l_linenumber").cast("bigint").alias("storages"))


@register("height_map", "SELECT l_partkey & 15 AS x, l_suppkey & 15 AS z, max(l_orderkey) AS top FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1, 2")
def height_map(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr("l_partkey & 15").alias("x"), F.expr("l_suppkey & 15").alias("z"), F.col("l_orderkey").alias("y"), "l_linestatus")
    return space.height_map(rows, "x", "z", "y", F.col("l_linestatus") != "O")


@register("voxel_explode", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def voxel_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


@register("array_palette", """
    SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS entries, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS size FROM lineitem GROUP BY 1
""")
def array_palette(spark, d):
    """Sorted local palettes of each group."""
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("refs"))
    entries, _ = palette.local_palette(F.col("refs"))
    return groups.select("l_orderkey", entries.alias("entries")).withColumn("size", F.size("entries"))


@register("array_indices", """
    WITH w AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS refs, list_sort(list(DISTINCT o_orderpriority)) AS entries FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(list_transform(refs, lambda r: list_position(entries, r) - 1), ',') AS indices FROM w
""")
def array_indices(spark, d):
    """Each element's index in its group's sorted palette, in order."""
    groups = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("rows"))
    values = groups.select("o_custkey", F.col("rows.o_orderpriority").alias("refs"))
    _, indices = palette.local_palette(F.col("refs"))
    return values.select("o_custkey", F.array_join(F.transform(indices, lambda i: i.cast("string")), ",").alias("indices"))


@register("box_fill", """
    WITH b AS (SELECT n_nationkey AS k, n_regionkey AS x1, 4 - n_regionkey AS x2, n_nationkey % 5 AS y1, n_nationkey % 3 AS y2, 0 AS z1, n_nationkey % 4 AS z2 FROM nation),
         c AS (SELECT k, x, y, z FROM b, (SELECT unnest(range(0, 5))::INTEGER AS x), (SELECT unnest(range(0, 5))::INTEGER AS y), (SELECT unnest(range(0, 5))::INTEGER AS z)
               WHERE x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AND z BETWEEN least(z1, z2) AND greatest(z1, z2))
    SELECT x, y, z, max(k) AS block FROM c GROUP BY 1, 2, 3
""")
def box_fill(spark, d):
    k = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(
        k.alias("block"), k.alias("at"), F.col("n_regionkey").alias("x1"), (4 - F.col("n_regionkey")).alias("x2"), (k % 5).alias("y1"), (k % 3).alias("y2"), F.lit(0).alias("z1"), (k % 4).alias("z2")
    )
    return space.fill_boxes(boxes, "at", "block")


@register("rotate_grid", "SELECT p_partkey, 15 - (p_size & 15) AS x1, p_partkey & 15 AS z1, 15 - (p_partkey & 15) AS x2, 15 - (p_size & 15) AS z2 FROM part")
def rotate_grid(spark, d):
    x, z = F.expr("p_partkey & 15"), F.expr("p_size & 15")
    (x1, z1), (x2, z2) = space.rotate_position(x, z, 16, 16, 1), space.rotate_position(x, z, 16, 16, 2)
    return table(spark, d, "part").select("p_partkey", x1.alias("x1"), z1.cast("bigint").alias("z1"), x2.cast("bigint").alias("x2"), z2.alias("z2"))


@register("rotate_props", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'east' WHEN 1 THEN 'south' WHEN 2 THEN 'west' ELSE 'north' END AS cardinal, CAST((p_size % 16 + 4) % 16 AS VARCHAR) AS sign FROM part
""")
def rotate_props(spark, d):
    part = table(spark, d, "part")
    ring = F.array(*[F.lit(v) for v in space.TEXT_RINGS["minecraft:cardinal_direction"]])
    rows = part.select("p_partkey", F.explode(F.array(
        F.struct(F.lit("minecraft:cardinal_direction").alias("key"), F.lit(False).alias("numeric"), F.get(ring, F.col("p_size") % 4).alias("value")),
        F.struct(F.lit("ground_sign_direction").alias("key"), F.lit(True).alias("numeric"), (F.col("p_size") % 16).cast("string").alias("value")),
    )).alias("p")).select("p_partkey", "p.*")
    turned = space.rotate_properties(rows)
    return turned.groupBy("p_partkey").agg(F.max_by("value", F.when(F.col("numeric"), 0).otherwise(1)).alias("cardinal"), F.max_by("value", F.when(F.col("numeric"), 1).otherwise(0)).alias("sign"))


@register("pad_clip", "SELECT l_orderkey, l_partkey & 31 AS x, l_linenumber AS layer FROM lineitem WHERE (l_partkey & 31) < 20 AND (l_suppkey & 15) < 9 AND l_linenumber < 5 AND l_linenumber >= 0")
def pad_clip(spark, d):
    """Cells outside the box, and layers past those wanted, are left out."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.expr("l_partkey & 31").alias("x"), F.expr("l_suppkey & 15").alias("z"), F.col("l_linenumber").alias("layer"))
    return rows.filter(space.inside(F.col("x"), F.col("layer"), F.col("z"), (20, 5, 9))).select("l_orderkey", "x", "layer")


@register("export_flat_index", "SELECT p_partkey, (p_partkey & 15) * 16 * 8 + (p_size & 15) * 8 + (p_partkey & 7) AS flat FROM part")
def export_flat_index(spark, d):
    return table(spark, d, "part").select("p_partkey", space.flat_index(F.expr("p_partkey & 15"), F.expr("p_size & 15"), F.expr("p_partkey & 7"), 16, 8).alias("flat"))


@register("schedule_restore", """
    SELECT o_orderkey, 1000 + greatest(1, o_orderkey % 50 - 20) AS fire FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderpriority = CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' ELSE '5-LOW' END
""")
def schedule_restore(spark, d):
    """Pending updates whose block is still the one they were scheduled for."""
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"))
    pending = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    fire = (F.lit(1000) + F.greatest(F.lit(1), F.col("o_orderkey") % 50 - 20)).alias("fire")
    return pending.join(now, ["o_custkey", "o_orderpriority"]).select("o_orderkey", fire)


@register("biome_lookup", "SELECT c_custkey, CAST(coalesce(n_nationkey, 1) AS INTEGER) AS biome FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def biome_lookup(spark, d):
    """Name to id with a default for unknown names."""
    known = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("id"))
    return table(spark, d, "customer").join(known, "c_nationkey", "left").select("c_custkey", F.coalesce("id", F.lit(1)).cast("int").alias("biome"))


@register("state_resolve", """
    SELECT p_partkey, coalesce(CASE WHEN p_size < 20 THEN p_brand END, CASE WHEN p_size < 40 THEN p_type END, 'minecraft:info_update') AS resolved FROM part
""")
def state_resolve(spark, d):
    """Direct lookup, then the upgraded form, then the placeholder."""
    part = table(spark, d, "part")
    direct = part.filter("p_size < 20").select("p_partkey", F.col("p_brand").alias("direct"))
    upgraded = part.filter("p_size < 40").select("p_partkey", F.col("p_type").alias("upgraded"))
    joined = part.select("p_partkey").join(direct, "p_partkey", "left").join(upgraded, "p_partkey", "left")
    return joined.select("p_partkey", F.coalesce("direct", "upgraded", F.lit("minecraft:info_update")).alias("resolved"))


@register("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@register("key_listing", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey = 7) > 0 AS has_seven FROM orders")
def key_listing(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderkey") == 7) > 0).alias("has_seven"))


@register("newest_checkpoint", "SELECT user_id, event_id AS generation FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'error') WHERE r = 1")
def newest_checkpoint(spark, d):
    """The newest valid footer of each file is adopted."""
    valid = table(spark, d, "events").filter("event_type <> 'error'")
    return valid.groupBy("user_id").agg(F.max("event_id").alias("generation"))


@register("dimension_of_file", """
    SELECT n_name, CASE WHEN f = 'overworld' THEN 0 WHEN f = 'nether' THEN 1 WHEN f = 'end' THEN 2 ELSE CAST(substr(f, 4) AS INTEGER) END AS dim
    FROM (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'overworld' WHEN 1 THEN 'nether' WHEN 2 THEN 'end' ELSE 'dim' || n_nationkey END AS f FROM nation)
""")
def dimension_of_file(spark, d):
    from voxquarry.sources.naming import dimension

    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, "overworld").when(k % 4 == 1, "nether").when(k % 4 == 2, "end").otherwise(F.concat(F.lit("dim"), k.cast("string")))
    return table(spark, d, "nation").select("n_name", dimension(F.concat(F.lit("/w/"), name, F.lit(".world"))).alias("dim"))


@register("settings_extra", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS difficulty, 0 AS unknown_keys FROM events")
def settings_extra(spark, d):
    """Known settings apart from the keys that no schema names."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", m["k"].cast("int").alias("difficulty"), F.size(F.array_except(F.map_keys(m), F.array(F.lit("k")))).alias("unknown_keys"))
