"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit set where more than half of its shingles' hashes
do.  Bits are split into blocks; two fingerprints that differ in at most
``distance`` bits agree in all but ``distance`` blocks, so each choice of
``blocks - distance`` blocks is a join key and close pairs share at least one.
Equal fingerprints are merged first.  Inside a bucket (one key) the Hamming
distances are verified, and what leaves it is a spanning forest of the links
found, not the links: a bucket of n fingerprints gives less than n rows however
similar they are.  Components of all forests are the classes.

A bucket of more than ``BUCKET`` fingerprints is dealt out as pairs of slices:
every pair of its members meets in exactly one task, so the result is the same
and no task holds more than two slices.

Edge cases: a null or empty text has no word and fingerprint zero, which links
like any other; rows with fewer words than a shingle have one shingle of all of
them; null ids are rows of a class but never its id unless alone in it (then the
class id is null); repeated rows are members each; an empty table gives an empty
result; other columns are carried through by :func:`near_duplicates` untouched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at, bounded_batches, drop_staged, numbered, pick, shuffle_width, signed64, staged, table, worker
from .components import components

SEED = 42
BUCKET = 1024


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z in lower case, repeats included."""
    parts = text.lower().split()  # bytes split at exactly [\x20\x09-\x0D]
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, n)) + np.arange(n)).tolist()
    starts = [0, *[e + 1 for e in ends[: n - words]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit (64 columns for each column of ``hashes``), lowest bit first.

    Full adders work on whole columns: three words of a weight become one of that
    weight and one of the next, until few are left to count bit by bit.
    """
    width = hashes.shape[1]
    total = np.zeros(64 * width, np.int64)
    level, weight = hashes, 1
    while len(level):
        carries = []
        while len(level) > 8:
            third = len(level) // 3
            a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
            both = a ^ b
            carries.append((a & b) | (both & c))
            level = np.concatenate([both ^ c, rest])
        bits = np.unpackbits(np.ascontiguousarray(level).view(np.uint8).reshape(len(level), -1), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return total


def majority(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint of one text: words of 64 bits, one for each column."""
    width = hashes.shape[1]
    if not len(hashes):
        return np.zeros(width, np.uint64)
    bits = (bit_counts(hashes) * 2 > len(hashes)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    return int(majority(shingle_hashes(text, words).reshape(-1, 1))[0])


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch["_bytes"].to_pylist()], dtype=np.uint64).view(np.int64)
            rest = [c for c in batch.schema.names if c != "_bytes"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(values, pa.int64())], names=[*rest, "fp"])

    return run


def add_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with the 64-bit fingerprint as a signed long."""
    narrow = pick(docs, "doc_id", "text").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_bytes"))
    return narrow.mapInArrow(worker(_fingerprints(words)), "doc_id long, fp long")


def block_keys(fps: np.ndarray, distance: int, blocks: int) -> list[np.ndarray]:
    """For each choice of ``blocks - distance`` blocks, the fingerprints with all other bits cleared."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [fps & np.uint64(sum(masks[i] for i in some)) for some in combinations(range(blocks), blocks - distance)]


def _keys(distance: int, blocks: int):
    def run(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for start in range(0, len(fps), 4096):
                part = fps[start : start + 4096]
                keys = block_keys(part, distance, blocks)
                choice = np.repeat(np.arange(len(keys), dtype=np.int32), len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(choice), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(part, len(keys)).view(np.int64))],
                    names=["choice", "block", "fp"],
                )

    return run


def forest(n: int, near) -> list[tuple[int, int]]:
    """Spanning forest of items 0..n-1; ``near(i, rest)`` says which of the items ``rest`` link to i.

    Items reached are taken out of the search, so a tight group costs one step
    for each member and what stays apart is compared with all the rest once.
    """
    left = np.arange(n)
    links = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit].tolist()
                links += [(i, j) for j in found]
                front += found
                left = left[~hit]
    return links


def _bucket_links(fps: np.ndarray, distance: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest; with ``side``, only pairs of unlike sides count."""
    if side is None:
        links = forest(len(fps), lambda i, rest: np.bitwise_count(fps[rest] ^ fps[i]) <= distance)
    else:
        links = forest(len(fps), lambda i, rest: (np.bitwise_count(fps[rest] ^ fps[i]) <= distance) & (side[rest] != side[i]))
    return links


def _verify(distance: int):
    """Forests of the buckets in a partition that is sorted by bucket."""

    def run(batches):
        open_key, held = None, []
        out: list[np.ndarray] = []

        def close():
            fps = np.concatenate([h[0] for h in held])
            if len(fps) > 1:
                side = np.concatenate([h[1] for h in held])
                sliced = len(open_key) > 2 and open_key[2] != open_key[3]
                for i, j in _bucket_links(fps, distance, side if sliced else None):
                    out.append((fps[i], fps[j]))

        def emit():
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            key = [batch[c].to_numpy() for c in ("choice", "block", "s", "t")]
            fps, side = batch["fp"].to_numpy().view(np.uint64), batch["slice"].to_numpy()
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if len(fps) else np.zeros(0, int)
            cuts = [0, *change.tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now = tuple(int(k[a]) for k in key)
                if now != open_key:
                    if held:
                        close()
                    open_key, held = now, []
                held.append((fps[a:b], side[a:b]))
            if len(out) > 10_000:
                yield emit()
                out = []
        if held:
            close()
        if out:
            yield emit()

    return run


def _deal(rows: DataFrame, bucket: int) -> DataFrame:
    """Rows (choice, block, fp) of the keys that two of them share, dealt out for comparison.

    Adds slice, and the pair of slices s, t that a row is compared in: (0, 0) in
    a bucket of ordinary size.
    """
    sizes = rows.groupBy("choice", "block").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(sizes, ["choice", "block"])
    slices = F.ceil(F.col("n") / bucket).cast("int")
    shared = shared.select("choice", "block", "fp", slices.alias("m"), F.pmod(F.xxhash64("fp"), slices).cast("int").alias("slice"))
    pairs = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return pairs.select("choice", "block", F.least("slice", "other").alias("s"), F.greatest("slice", "other").alias("t"), "fp", "slice")


BY = ["choice", "block", "s", "t"]


def link_fingerprints(fps: DataFrame, distance: int = 3, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """(u, v): pairs of distinct fingerprints (column fp) that connect all that are close."""
    rows = staged(fps.select("fp").distinct().mapInArrow(worker(_keys(distance, blocks)), "choice int, block long, fp long"), "blocks")
    grouped = _deal(rows, bucket).repartition(shuffle_width(fps.sparkSession), *BY).sortWithinPartitions(*BY)
    return grouped.mapInArrow(worker(_verify(distance)), "u long, v long")


def classes(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp)."""
    ids = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-ids")
    found = components(link_fingerprints(ids, distance, blocks))
    rooted = ids.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


# The wider form: similarity of word shingles instead of a few differing bits.

#: Bands of minima (join keys), minima of a band, and bits that verify.
BANDS, BAND_ROWS, CHECK_BITS = 24, 6, 1024
CHUNK = 1 << 15


def _columns(n: int, salt: int) -> np.ndarray:
    return np.array([(0x9E3779B97F4A7C15 * (salt + k + 1)) & (2**64 - 1) for k in range(n)], dtype=np.uint64)


def wide(hashes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A fingerprint of 64 bits for each column: every column mixes the shingles' hashes anew."""
    total = np.zeros(64 * len(columns), np.int64)
    for a in range(0, len(hashes), CHUNK):
        x = hashes[a : a + CHUNK, None] ^ columns
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        total += bit_counts(x ^ (x >> np.uint64(31)))
    return np.packbits((total * 2 > len(hashes)).astype(np.uint8), bitorder="little")


def differing_share(similarity: float) -> float:
    """Expected share of differing bits for two equally long shingle sets of this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def allowed_bits(similarity: float, bits: int = CHECK_BITS) -> int:
    """Differing bits beyond which a pair isn't worth an exact comparison.

    Five standard deviations over a quarter more than the expected share: sets of
    a few shingles of unequal number differ in so many more bits.
    """
    share = min(0.5, 1.25 * differing_share(similarity))
    return min(bits, int(bits * share + 5 * np.sqrt(bits * share * (1 - share))))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: the minima of ``BAND_ROWS`` permutations of the shingle set, mixed.

    Two sets agree in a minimum with the probability of their Jaccard similarity,
    however the texts differ: at 0.8 a pair shares one of the keys in 99.9 of 100 cases.
    """
    n = BANDS * BAND_ROWS
    factors, least = _columns(n, 3000) | np.uint64(1), np.full(n, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 4096):
        x = shingles[a : a + 4096]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        np.minimum(least, (x * factors[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, -1)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], dtype=np.uint64)


def _wide_prints(words: int):
    def run(batches):
        check = _columns(CHECK_BITS // 64, 2000)
        for batch in batches:
            rows = []
            for doc, body, text in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist(), batch["_bytes"].to_pylist()):
                normal = b" ".join(text.lower().split())
                fine = np.unique(shingle_hashes(normal, words))
                rows.append((doc, body, signed64(xxhash.xxh3_64_intdigest(normal)), bands(fine).tobytes(), wide(fine, check).tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "body", "fp", "keys", "bits"])

    return run


def _wide_keys(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            blocks = np.frombuffer(b"".join(part["keys"].to_pylist()), dtype=np.int64)
            choice = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(choice), pa.array(blocks), pa.array(np.repeat(part["fp"].to_numpy(), BANDS))], names=["choice", "block", "fp"])


def _shingle_sets(words: int):
    """(fp, shingles) of each text: the sorted hashes of its distinct shingles."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets = [np.unique(shingle_hashes(unpack(t), words)).tobytes() for t in batch["packed"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return run


def _normal_texts(batches):
    """(fp, packed) of each text: the hash of its words, and the words compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        normal = [b" ".join(t.lower().split()) for t in batch["_bytes"].to_pylist()]
        fps = [signed64(xxhash.xxh3_64_intdigest(t)) for t in normal]
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([pack(t) for t in normal], pa.binary())], names=["fp", "packed"])


def jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct values have this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two sorted runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (len(both) - common)


def _exact_verify(most: int, similarity: float):
    """Forests of exact links among the classes in a partition that is sorted by class."""

    def run(batches):
        from .neighbours import _runs

        for (_, _, s, t), (fps, sides, bits, shingles) in _runs(batches, BY, ["fp", "slice", "bits", "shingles"]):
            if len(fps) < 2:
                continue
            m = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(fps), -1)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in shingles]
            side = np.array(sides)

            def near(i, rest, m=m, sets=sets, side=side, cross=s != t):
                hit = np.bitwise_count(m[rest] ^ m[i]).sum(axis=1) <= most
                if cross:
                    hit &= side[rest] != side[i]
                for k in np.flatnonzero(hit):
                    hit[k] = jaccard_at_least(sets[i], sets[rest[k]], similarity)
                return hit

            out = [(fps[i], fps[j]) for i, j in forest(len(fps), near)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return run


def _wide_verify(most: int):
    """Forests of the buckets in a partition that is sorted by bucket."""

    def run(batches):
        from .neighbours import _runs

        out = []
        for (_, _, s, t), (fps, sides, bits) in _runs(batches, BY, ["fp", "slice", "bits"]):
            if len(fps) < 2:
                continue
            m = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(fps), -1)
            side = np.array(sides)

            def near(i, rest, m=m, side=side, cross=s != t):
                hit = np.bitwise_count(m[rest] ^ m[i]).sum(axis=1) <= most
                return hit & (side[rest] != side[i]) if cross else hit

            out += [(fps[i], fps[j]) for i, j in forest(len(fps), near)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return run


def _exact_links(narrow: DataFrame, texts: DataFrame, loose: DataFrame, words: int, similarity: float, most: int, bucket: int) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v): links that connect all texts of one loose class that are similar by their shingle sets; and the staged tables they are read from."""
    spark = narrow.sparkSession
    members = staged(loose.select(F.col("u").alias("fp"), F.col("v").alias("block")).unionByName(loose.select(F.col("v").alias("fp"), F.col("v").alias("block")).distinct()), "members")
    normal = narrow.mapInArrow(worker(_normal_texts), "fp long, packed binary").join(members.select("fp"), "fp", "left_semi")
    packed = normal.groupBy("fp").agg(F.first("packed").alias("packed"))
    sets = staged(packed.mapInArrow(worker(_shingle_sets(words)), "fp long, shingles binary").join(texts.select("fp", "bits"), "fp"), "sets")
    dealt = _deal(members.select(F.lit(0).alias("choice"), "block", "fp"), bucket).join(sets, "fp")
    grouped = dealt.repartition(shuffle_width(spark), *BY).sortWithinPartitions(*BY)
    return grouped.mapInArrow(worker(_exact_verify(most, similarity)), "u long, v long"), [members, sets]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, body, class_id, first) of every row of ``docs``.

    Texts are linked where their sets of ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more.  Candidates share one of ``BANDS`` keys
    of minima, and the Hamming distance of ``CHECK_BITS``-bit fingerprints must
    not rule them out; within the classes that these make, links are settled by
    the shingle sets themselves.  ``first`` marks the row of the class with the
    least (doc_id, body), null ids last; ``body`` is Spark's xxhash64 of the text.
    Texts with equal words are one vertex, known by a 64-bit hash of the words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce("text", F.lit(""))
    narrow = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("body"), F.encode(text, "UTF-8").alias("_bytes"))
    prints = staged(narrow.mapInArrow(worker(_wide_prints(words)), "doc_id long, body long, fp long, keys binary, bits binary"), "prints")
    texts = staged(prints.groupBy("fp").agg(F.first("keys").alias("keys"), F.first("bits").alias("bits")), "texts")
    rows = staged(texts.select("fp", "keys").mapInArrow(worker(_wide_keys), "choice int, block long, fp long"), "blocks")
    dealt = _deal(rows, bucket).join(texts.select("fp", "bits"), "fp")
    grouped = dealt.repartition(shuffle_width(spark), *BY).sortWithinPartitions(*BY)
    most = allowed_bits(similarity)
    loose = components(grouped.mapInArrow(worker(_wide_verify(most)), "u long, v long"))
    drop_staged(rows)
    links, used = _exact_links(narrow, texts, loose, words, similarity, most, bucket)
    found = components(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    for table_ in (*used, texts, loose):
        drop_staged(table_)
    members = prints.select("doc_id", "body", "fp").join(found, "fp", "left").withColumn("class_id", F.coalesce("root", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("body").alias("c"))
    least = members.groupBy("class_id").agg(F.min(order).alias("least"), F.count("*").alias("n")).filter("n > 1")
    # A table of its own, so that the rows of a large class can be split up in the join.
    out = members.join(staged(least.drop("n"), "classes"), "class_id", "left")
    first = F.col("doc_id").eqNullSafe(F.col("least.b")) & (F.col("body") == F.col("least.c"))
    return out.select("doc_id", "body", "class_id", (F.col("least").isNull() | first).alias("first"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: the one of the least doc_id."""
    others = near_duplicates(docs, words, similarity).filter("NOT first").select(F.col("doc_id").alias("_doc2"), F.col("body").alias("_body2")).distinct()
    d = numbered(docs).withColumns({"_doc": at(docs, "doc_id").cast("bigint"), "_body": F.xxhash64(F.coalesce(at(docs, "text"), F.lit("")))})
    left = d.join(others, d["_doc"].eqNullSafe(others["_doc2"]) & (d["_body"] == others["_body2"]), "left_anti")
    # Only repeated rows of one id and text are still there twice.
    once = left.dropDuplicates(["_doc", "_body"])
    return once.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op2_simhash(spark, sf_dir) -> DataFrame:
    """Fingerprint and class of every document."""
    prints = staged(add_fingerprint(table(spark, sf_dir, "documents")), "prints")
    out = prints.join(classes(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
