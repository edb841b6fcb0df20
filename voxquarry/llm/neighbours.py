"""Approximate nearest neighbours by cosine: NN-descent graph and greedy search.

Equal vectors are one node of the graph, and vectors of each length have a graph of
their own.  A first graph comes from random hyperplane leaves, in which members are
compared; NN-descent then improves it: in each round the neighbours of a node, listed
and listing, meet there, and each keeps the nearest it meets.  Only pairs of which one
is new at that node are compared, and only what beats the last of a full list is sent.

A node may be listed by any number of others.  The ``DEGREE`` nearest of these are its
reverse neighbours; the others hang on it as a chain, each beside the next nearer one,
so every list has a bounded length, no link is dropped, and every node can be reached
from those it lists.

Searches walk the graph greedily with a beam: a round joins the beam's unexpanded nodes
with their neighbours, scores those not seen yet where their vectors lie, and ends when
a beam holds expanded nodes only.  Graph and walk use unit vectors of 16-bit components
and compare squared distances; the whole beam is scored again on the original vectors
in double precision.

Parameters: ``DEGREE`` neighbours kept for a node, at most ``ROUNDS`` of NN-descent,
``BEAM`` nodes held by a search (twice k at least).  They set recall and cost, never
which rows are indexed or searched.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; vectors of unlike length are no candidates of each other; rows without an
id take no part; of repeated rows of one id the bytewise least vector counts, once;
other columns are not read, whatever they are called; with fewer than k candidates
there are fewer results; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import at, bounded_batches, drop_staged, numbered, shuffle_width, staged, table, worker

DEGREE = 24
ROUNDS = 6
#: Share of list entries that a round must renew for another to follow.
SETTLED = 0.002
BEAM = 224
TREES = 4
LEAF = 400
#: Nodes where every search starts, besides the query's own.
ENTRIES = 8
#: A score below any other.
NONE = np.float32(-9)
LISTS = "u long, ids binary, scores binary, flags binary"


def _lists(u, ids, scores, flags) -> pa.RecordBatch:
    """Neighbour lists: ids, scores from the best, and for each entry whether it is new."""
    columns = [pa.array(u, pa.int64()), *(pa.array(c, pa.binary()) for c in (ids, scores, flags))]
    return pa.RecordBatch.from_arrays(columns, names=["u", "ids", "scores", "flags"])


def _clean(id_col: str, vec_col: str):
    def run(batches):
        for batch in batches:
            ids, raw, sizes = [], [], []
            for i, v in zip(batch[id_col].to_pylist(), batch[vec_col].to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, dtype="<f8")
                peak = np.abs(x).max() if np.isfinite(x).all() else 0.0
                if peak == 0.0:
                    continue
                ids.append(i)
                raw.append(x.tobytes())
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "raw", "size"])

    return run


def unit(raw: bytes) -> np.ndarray:
    """The direction, scaled first so that no square overflows or vanishes."""
    x = np.frombuffer(raw, dtype="<f8")
    x = x / np.abs(x).max()
    return x / np.sqrt(np.dot(x, x))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision on the original components (scaled by their largest, which cancels)."""
    with np.errstate(over="ignore", under="ignore"):
        d, n = np.dot(a, b), np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
    if not (np.isfinite(d) and np.isfinite(n) and 1e-280 < n):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        d, n = np.dot(a, b), np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
    return float(d / n)


def _code(batches):
    """16-bit components of the unit vectors; a common factor of a vector doesn't matter after scaling by its norm."""
    for batch in batches:
        rows = [unit(r) for r in batch["raw"].to_pylist()]
        codes = [np.rint(x * (32767 / np.abs(x).max())).astype("<i2").tobytes() for x in rows]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(codes, pa.binary())], names=["node", "code"])


def decode(codes: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(codes), dtype="<i2").reshape(len(codes), -1).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def closeness(m: np.ndarray) -> np.ndarray:
    """Minus half the squared distances: ordered like the cosine, and precise where vectors nearly coincide."""
    g, q = m @ m.T, (m * m).sum(axis=1) / 2
    g -= q[:, None]
    g -= q[None, :]
    np.fill_diagonal(g, NONE)
    return g


def _leaves(trees: int, bits: int, centre: np.ndarray):
    """(tree, leaf) of each node by the signs of projections."""

    def run(batches):
        planes = np.random.default_rng(7).normal(size=(trees, max(bits, 1), len(centre))).astype(np.float32)
        for batch in batches:
            codes = batch["code"].to_pylist()
            if not codes:
                continue
            x = decode(codes) - centre
            for t in range(trees):
                leaf = ((x @ planes[t, :bits].T > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, np.int32)), pa.array(leaf), batch["node"], batch["code"]], names=["tree", "leaf", "node", "code"])

    return run


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))


def _runs(batches, keys: list[str], columns: list[str]):
    """Columns of each run of equal keys in a sorted partition, as lists of numpy arrays or Python lists."""
    now, held = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k = [batch[c].to_numpy() for c in keys]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1).tolist(), n]
        cols = [batch[c].to_pylist() for c in columns]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(x[a]) for x in k)
            if key == now:
                for h, c in zip(held, cols):
                    h += c[a:b]
            else:
                if now is not None:
                    yield now, held
                now, held = key, [c[a:b] for c in cols]
    if now is not None:
        yield now, held


def _compare_all(degree: int, leaf_size: int):
    """First lists within each leaf, in slices of bounded size."""

    def run(batches):
        for _, (nodes, codes) in _runs(batches, ["tree", "leaf", "part"], ["node", "code"]):
            pieces = -(-len(nodes) // (2 * leaf_size))
            for s in range(pieces):
                ids, m = np.array(nodes[s::pieces], dtype=np.int64), decode(codes[s::pieces])
                if len(ids) < 2:
                    continue
                scores = closeness(m)
                top = _top(scores, min(degree, len(ids) - 1))
                best = np.take_along_axis(scores, top, 1).astype(np.float32)
                yield _lists(ids, [x.tobytes() for x in ids[top]], [x.tobytes() for x in best], [b"\x01" * top.shape[1]] * len(ids))

    return run


def _keep_best(degree: int):
    """Merge the lists of each u in a sorted partition into its best ``degree``; what an older list holds isn't new."""

    def merge(u, ids, scores, flags):
        sizes = [len(x) // 8 for x in ids]
        owner = np.repeat(np.array(u, dtype=np.int64), sizes)
        w, s = np.frombuffer(b"".join(ids), dtype=np.int64), np.frombuffer(b"".join(scores), dtype=np.float32)
        f = np.frombuffer(b"".join(flags), dtype=np.uint8)
        # The scores of a pair may differ in the last bits, so repeats are found by id; the older comes first.
        order = np.lexsort((f, w, owner))
        owner, w, s, f = owner[order], w[order], s[order], f[order]
        first = np.ones(len(w), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (w[1:] != w[:-1])
        owner, w, s, f = owner[first], w[first], s[first], f[first]
        order = np.lexsort((w, -s, owner))
        owner, w, s, f = owner[order], w[order], s[order], f[order]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff([*starts, len(owner)]))
        keep = rank < degree
        owner, w, s, f = owner[keep], w[keep], s[keep], f[keep]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = [*starts[1:].tolist(), len(owner)]
        return _lists(owner[starts], *([x[a:b].tobytes() for a, b in zip(starts, ends)] for x in (w, s, f)))

    def run(batches):
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("u", "ids", "scores", "flags"))):
                if len(held[0]) >= 50_000 and row[0] != held[0][-1]:
                    yield merge(*held)
                    held = [[], [], [], []]
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield merge(*held)

    return run


def _aged(batches):
    """Lists whose entries are old."""
    for batch in batches:
        yield _lists(batch["u"], batch["ids"], batch["scores"], [bytes(len(x)) for x in batch["flags"].to_pylist()])


def _worst(degree: int):
    """(u, worst, fresh): the score that a full list asks for, and its number of new entries."""

    def run(batches):
        for batch in batches:
            scores = [np.frombuffer(x, dtype=np.float32) for x in batch["scores"].to_pylist()]
            worst = [float(x[-1]) if len(x) >= degree else float(NONE) for x in scores]
            fresh = [sum(x) for x in batch["flags"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["u"], pa.array(worst, pa.float32()), pa.array(fresh, pa.int64())], names=["u", "worst", "fresh"])

    return run


def _links(batches):
    """(u, w, score, fresh): a row for each entry of the lists."""
    for batch in batches:
        ids = batch["ids"].to_pylist()
        u = np.repeat(batch["u"].to_numpy(), [len(x) // 8 for x in ids])
        columns = [pa.array(np.frombuffer(b"".join(x), dtype=t)) for x, t in ((ids, np.int64), (batch["scores"].to_pylist(), np.float32), (batch["flags"].to_pylist(), np.int8))]
        yield pa.RecordBatch.from_arrays([pa.array(u), *columns], names=["u", "w", "score", "fresh"])


def adjacency(graph: DataFrame, degree: int) -> DataFrame:
    """(centre, member, fresh): listed nodes, the nearest listing ones, and the next in the chains of all others.

    The window streams over the listing nodes of one node, sorted with spill.
    """
    links = graph.mapInArrow(worker(_links), "u long, w long, score float, fresh tinyint")
    by = W.partitionBy("w").orderBy(F.desc("score"), "u")
    ranked = links.select("u", "w", "fresh", F.row_number().over(by).alias("r"), F.lag("u").over(by).alias("nearer"))
    holder = F.when(F.col("r") <= degree, F.col("w")).otherwise(F.col("nearer"))
    both = F.explode(F.array(
        F.struct(F.col("u").alias("centre"), F.col("w").alias("member"), "fresh"), F.struct(holder.alias("centre"), F.col("u").alias("member"), "fresh"),
    ))
    return ranked.select(both.alias("x")).select("x.*")


def _meet(degree: int):
    """Local joins: members of a centre keep what they meet there and their lists have room for."""

    def run(batches):
        for _, (members, codes, worst, fresh) in _runs(batches, ["centre"], ["member", "code", "worst", "fresh"]):
            known: dict[int, int] = {}
            for i, member in enumerate(members):
                if member not in known or fresh[i] > fresh[known[member]]:
                    known[member] = i
            if len(known) < 2:
                continue
            at = list(known.values())
            ids, new = np.array([members[i] for i in at], dtype=np.int64), np.array([fresh[i] for i in at], dtype=bool)
            if not new.any():
                continue
            scores = closeness(decode([codes[i] for i in at])).astype(np.float32)
            scores[~(new[:, None] | new[None, :])] = NONE
            scores[scores <= np.array([worst[i] for i in at], dtype=np.float32)[:, None]] = NONE
            top = _top(scores, min(degree, len(ids) - 1))
            best = np.take_along_axis(scores, top, 1)
            some = best > NONE
            counts = some.sum(axis=1)
            got = np.flatnonzero(counts)
            if not len(got):
                continue
            cuts = np.cumsum(counts)[:-1]
            u, w, s = ids[got], np.split(ids[top][some], cuts), np.split(best[some], cuts)
            yield _lists(u, [w[i].tobytes() for i in got], [s[i].tobytes() for i in got], [b"\x01" * int(counts[i]) for i in got])

    return run


def _in_tasks(batches):
    """Larger batches out of many small ones."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 10_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _chained(*steps):
    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def _free_shuffles(spark) -> None:
    """Let Spark drop the shuffle files of finished rounds now and not at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, raw, size) of the rows that take part, staged."""
    bounded_batches(df.sparkSession)
    rows = numbered(df).select(at(df, id_col).cast("bigint").alias("id"), at(df, vec_col).alias("vector"))
    rows = staged(rows.mapInArrow(worker(_clean("id", "vector")), "id long, raw binary, size int"), "vectors")
    least = F.min(F.struct("raw", "size")).alias("v")
    return rows.groupBy("id").agg(least).select("id", "v.raw", "v.size")


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES, leaf_size: int = LEAF) -> DataFrame:
    """Neighbour lists (LISTS) of ``nodes`` (node, code)."""
    spark = nodes.sparkSession
    n = nodes.count()
    by_u = lambda lists: staged(
        lists.repartition(shuffle_width(spark), "u").sortWithinPartitions("u").mapInArrow(worker(_keep_best(degree)), LISTS), "graph"
    )
    if n < 2:
        return spark.createDataFrame([], LISTS)
    bits = max(0, int(np.ceil(np.log2(n / leaf_size))))

    def add_up(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([decode(batch["code"].to_pylist()).sum(axis=0).tobytes()], pa.binary())], names=["sum"])

    sums = nodes.select("code").mapInArrow(worker(add_up), "sum binary")
    # A vector for each Arrow batch: summed up by Spark, position by position.
    width = len(nodes.first()["code"]) // 2

    def positions(batches):
        for batch in batches:
            m = np.array([np.frombuffer(x, "<f8") for x in batch["sum"].to_pylist()]).reshape(-1, width).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int64()), pa.array(m)], names=["at", "part"])

    centre = np.zeros(width, np.float32)
    for row in sums.mapInArrow(worker(positions), "at long, part double").groupBy("at").agg(F.sum("part").alias("total")).collect():
        centre[row["at"]] = row["total"] / n

    dealt = staged(nodes.select("node", "code").mapInArrow(worker(_leaves(trees, bits, centre)), "tree int, leaf long, node long, code binary"), "leaves")
    sizes = dealt.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    # A leaf of many rows is dealt to several tasks.
    parts = F.ceil(F.col("n") / (4 * leaf_size)).cast("int")
    placed = dealt.join(sizes, ["tree", "leaf"]).select("tree", "leaf", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "code")
    by = ["tree", "leaf", "part"]
    first = placed.repartition(shuffle_width(spark), *by).sortWithinPartitions(*by).mapInArrow(worker(_chained(_compare_all(degree, leaf_size), _in_tasks)), LISTS)
    graph = by_u(first)
    drop_staged(dealt)
    for _ in range(rounds):
        limits = graph.mapInArrow(worker(_worst(degree)), "u long, worst float, fresh long")
        if limits.agg(F.sum("fresh")).first()[0] <= SETTLED * n * degree:
            break
        known = nodes.join(limits.select(F.col("u").alias("node"), "worst"), "node", "left")
        known = known.select(F.col("node").alias("member"), "code", F.coalesce("worst", F.lit(float(NONE)).cast("float")).alias("worst"))
        own = nodes.select(F.col("node").alias("centre"), F.col("node").alias("member"), F.lit(0).cast("tinyint").alias("fresh"))
        rows = adjacency(graph, degree).unionByName(own).join(known, "member").select("centre", "member", "code", "worst", "fresh")
        rows = rows.repartition(shuffle_width(spark), "centre").sortWithinPartitions("centre")
        found = rows.mapInArrow(worker(_chained(_meet(degree), _in_tasks)), LISTS)
        better = by_u(found.unionByName(graph.mapInArrow(worker(_aged), LISTS)))
        drop_staged(graph)
        graph = better
        _free_shuffles(spark)
    return graph


STATE = "q long, code binary, ids binary, scores binary, done binary, seen binary, fresh binary, waiting int, worst float"


def _start(entries: list[int]):
    def run(batches):
        for batch in batches:
            rows = []
            for q, code in zip(batch["q"].to_pylist(), batch["code"].to_pylist()):
                fresh = np.unique(np.array([q, *entries], dtype=np.int64))
                rows.append((q, code, b"", b"", b"", fresh.tobytes(), fresh.tobytes(), len(fresh), float(NONE)))
            yield _state_batch(rows)

    return run


def _state_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 9
    types = [pa.int64(), *[pa.binary()] * 6, pa.int32(), pa.float32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["q", "code", "ids", "scores", "done", "seen", "fresh", "waiting", "worst"])


def _wanted(batches):
    """(q, node, code, worst) of the nodes that a search asks for, with its own vector and the score that its beam asks for."""
    for batch in batches:
        fresh, asks = batch["fresh"].to_pylist(), batch.select(["q", "code", "worst"])
        at = np.repeat(np.arange(len(fresh)), [len(x) // 8 for x in fresh])
        w = np.frombuffer(b"".join(fresh), dtype=np.int64)
        for a in range(0, len(w), 20_000):
            rows = asks.take(pa.array(at[a : a + 20_000]))
            yield pa.RecordBatch.from_arrays([rows["q"], pa.array(w[a : a + 20_000]), rows["code"], rows["worst"]], names=["q", "node", "code", "worst"])


def _score(beam: int):
    """Score what searches ask for where it lies; of a batch, each search is sent the best only."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = decode(batch["code"].to_pylist()), decode(batch["at_node"].to_pylist())
            s = (-((a - b) ** 2).sum(axis=1) / 2).astype(np.float32)
            some = s > batch["worst"].to_numpy()
            q, w, s = batch["q"].to_numpy()[some], batch["node"].to_numpy()[some], s[some]
            order = np.lexsort((w, -s, q))
            q, w, s = q[order], w[order], s[order]
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
            ends = np.minimum([*starts[1:].tolist(), len(q)][: len(starts)], starts + beam + 1)
            parts = [[x[i:j].tobytes() for i, j in zip(starts, ends)] for x in (w, s)]
            yield pa.RecordBatch.from_arrays([pa.array(q[starts]), *(pa.array(x, pa.binary()) for x in parts)], names=["q", "near", "near_scores"])

    return run


def _advance(beam: int):
    """Take the scored nodes that came for each search into its beam and say which nodes to expand."""

    def run(batches):
        rows = []
        for (q,), cols in _runs(batches, ["q"], ["kind", "near", "near_scores", "code", "ids", "scores", "done", "seen"]):
            kind, near, near_scores, codes, ids, scores, done, seen = cols
            at = kind.index(0)
            new = [i for i in range(len(kind)) if kind[i]]
            came = np.frombuffer(b"".join(near[i] for i in new), np.int64)
            w = np.concatenate([np.frombuffer(ids[at], np.int64), came])
            s = np.concatenate([np.frombuffer(scores[at], np.float32), np.frombuffer(b"".join(near_scores[i] for i in new), np.float32)])
            d = np.concatenate([np.frombuffer(done[at], np.uint8), np.zeros(len(came), np.uint8)])
            # The query's own node is expanded but takes no place in the beam's order of others.
            order = np.lexsort((w, -s))[: beam + 1]
            w, s, d = w[order], s[order], d[order]
            fresh = w[d == 0]
            worst = float(s[-1]) if len(s) > beam else float(NONE)
            rows.append((q, codes[at], w.tobytes(), s.tobytes(), np.ones(len(w), np.uint8).tobytes(), seen[at], fresh.tobytes(), len(fresh), worst))
            if len(rows) >= 200:
                yield _state_batch(rows)
                rows = []
        if rows:
            yield _state_batch(rows)

    return run


def _unseen(batches):
    """Of the neighbours that came for each search, those it hasn't seen."""
    rows = []
    for (q,), cols in _runs(batches, ["q"], ["kind", "near", "code", "ids", "scores", "done", "seen", "worst"]):
        kind, near, codes, ids, scores, done, seen, worst = cols
        at = kind.index(0)
        came = np.unique(np.frombuffer(b"".join(near[i] for i in range(len(kind)) if kind[i]), dtype=np.int64))
        old = np.frombuffer(seen[at], np.int64)
        new = np.setdiff1d(came, old, assume_unique=True)
        rows.append((q, codes[at], ids[at], scores[at], done[at], np.union1d(old, new).tobytes(), new.tobytes(), len(new), worst[at]))
        if len(rows) >= 200:
            yield _state_batch(rows)
            rows = []
    if rows:
        yield _state_batch(rows)


def _around(batches):
    """Members of each centre in a sorted partition."""
    for (centre,), (members,) in _runs(batches, ["centre"], ["member"]):
        yield pa.RecordBatch.from_arrays([pa.array([centre], pa.int64()), pa.array([np.unique(np.array(members, np.int64)).tobytes()], pa.binary())], names=["node", "near"])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, degree: int = DEGREE, beam: int = BEAM, entries: int = ENTRIES) -> DataFrame:
    """(q, node) of the nodes in the last beam of each of ``queries`` (q, code); q may be a node itself.

    Each round joins twice: expanded nodes with their neighbours, and neighbours
    not seen before with their vectors.
    """
    spark = graph.sparkSession
    width = shuffle_width(spark)
    held = adjacency(graph, degree).select("centre", "member").repartition(width, "centre").sortWithinPartitions("centre")
    around = staged(held.mapInArrow(worker(_chained(_around, _in_tasks)), "node long, near binary"), "around")
    first = [r["node"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(entries).select("node").collect()]
    state = staged(queries.mapInArrow(worker(_start(first)), STATE), "search")
    own, null = ["code", "ids", "scores", "done", "seen", "worst"], F.lit(None).cast("binary")
    empty = [null.alias(c) for c in own[:-1]] + [F.lit(None).cast("float").alias("worst")]
    vectors_ = nodes.select("node", F.col("code").alias("at_node"))
    while True:
        wanted = state.mapInArrow(worker(_wanted), "q long, node long, code binary, worst float").join(vectors_, "node")
        came = wanted.mapInArrow(worker(_score(beam)), "q long, near binary, near_scores binary")
        came = came.select("q", F.lit(1).alias("kind"), "near", "near_scores", *empty)
        base = state.select("q", F.lit(0).alias("kind"), null.alias("near"), null.alias("near_scores"), *own)
        scored = base.unionByName(came).repartition(width, "q").sortWithinPartitions("q").mapInArrow(worker(_advance(beam)), STATE)
        scored = staged(scored, "search")
        drop_staged(state)
        if not scored.agg(F.sum("waiting")).first()[0]:
            break
        near = scored.mapInArrow(worker(_wanted), "q long, node long, code binary, worst float").select("q", "node").join(around, "node")
        base = scored.select("q", F.lit(0).alias("kind"), null.alias("near"), *own)
        came = near.select("q", F.lit(1).alias("kind"), "near", *empty)
        state = staged(base.unionByName(came).repartition(width, "q").sortWithinPartitions("q").mapInArrow(worker(_unseen), STATE), "search")
        drop_staged(scored)
    drop_staged(around)

    def found(batches):
        for batch in batches:
            ids = batch["ids"].to_pylist()
            q = np.repeat(batch["q"].to_numpy(), [len(x) // 8 for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.frombuffer(b"".join(ids), dtype=np.int64))], names=["q", "node"])

    out = staged(scored.mapInArrow(worker(found), "q long, node long"), "found")
    drop_staged(scored)
    return out


def _exact(batches):
    for batch in batches:
        scores = [cosine(np.frombuffer(a, "<f8"), np.frombuffer(b, "<f8")) for a, b in zip(batch["raw"].to_pylist(), batch["q_raw"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["q"], batch["node"], pa.array(scores, pa.float64())], names=["q", "node", "score"])


ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 5, **options) -> DataFrame:
    """The k nearest other rows of each row where ``is_query`` (a function of the id column) holds."""
    spark = df.sparkSession
    rows = staged(vectors(df, id_col, vec_col), "vectors")
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("asked"))
    out = spark.createDataFrame([], ANSWER)
    # A row, and a graph, for each length that vectors have.
    for size in sorted(r["size"] for r in sizes.filter("n > 1 AND asked > 0").collect()):
        out = out.unionByName(_nearest(rows.filter(F.col("size") == size).select("id", "raw"), is_query, k, options))
    return out


def _nearest(rows: DataFrame, is_query, k: int, options: dict) -> DataFrame:
    """:func:`nearest` of rows (id, raw) of one length."""
    order = W.partitionBy("raw").orderBy("id")
    # Of equal vectors the first k + 1 are enough for any answer; the limit is pushed below the shuffle.
    few = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    few = staged(few.select("id", "raw", "r"), "members")
    heads = staged(few.filter("r = 1").select(F.col("id").alias("node"), "raw"), "heads")
    members = few.join(heads, "raw").select("node", "id")
    nodes = staged(heads.mapInArrow(worker(_code), "node long, code binary"), "nodes")
    graph = build_graph(nodes, **{a: b for a, b in options.items() if a in ("degree", "rounds", "trees", "leaf_size")})
    asked = staged(rows.filter(is_query(F.col("id"))).join(heads, "raw").select("id", "node"), "asked")
    queries = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "code")
    walk = {a: b for a, b in options.items() if a in ("degree", "entries")}
    found = search(graph, nodes, queries, beam=max(options.get("beam", BEAM), 2 * k), **walk)
    drop_staged(graph)
    pairs = found.join(heads, "node").join(heads.select(F.col("node").alias("q"), F.col("raw").alias("q_raw")), "q")
    scored = staged(pairs.select("q", "node", "raw", "q_raw").mapInArrow(worker(_exact), "q long, node long, score double"), "scored")
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    top = scored.join(members, "node").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    answers = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(top, "q").filter("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias("vec_id"), "score").filter(F.col("rank") <= k)


def op8_neighbours(spark, sf_dir) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 50 == 0)
