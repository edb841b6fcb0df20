"""Line dedup: drop lines that many documents share.

Each document yields one row per distinct long line: a 128-bit hash of the
line's key, the document and the line's positions.  These rows are
range-partitioned on (hash, document) and sorted so, largest document first;
streaming a partition, the first occurrence of a hash is its keeper and the rest
are dropped once enough documents are seen.  A hash that many documents hold is
spread over many partitions by the document in the range key; the groups at a
partition's two ends (two hashes for each partition) may go on elsewhere, so
their rows are decided after their counts, at most two for each partition, are
added up.  What comes back is a compressed keep bitmap per document.

Key of a line: the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower
case.  Keys of ``min_chars`` code points or more that ``min_docs`` documents
hold lose all lines but those in the largest doc_id that holds them.

Edge cases: a null or empty text is one empty line; a null doc_id counts as one
document below all others; repeated rows of one doc_id count as one document and
are all treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at, bounded_batches, drop_staged, numbered, pick, signed64, staged, table, worker

BLANK = b" \t\n\x0b\x0c\r"
NAMES = ["h1", "h2", "doc_id", "body", "n_lines", "at"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
OCCURRENCES = "h1 long, h2 long, doc_id long, body long, n_lines long, at binary"
CHUNK = 4096


def line_keys(text: bytes, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and positions by 128-bit hash of each key that is long enough."""
    lines = text.lower().split(b"\n")
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if len(line) < min_chars:
            continue
        key = line.strip(BLANK)
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
            continue
        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return len(lines), found


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _occurrences(min_chars: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, body, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "body", "text"))):
                n, found = line_keys(text, min_chars)
                for digest, at in found.items():
                    h1, h2 = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
                    rows.append((signed64(h1), signed64(h2), doc, body, n, np.array(at, dtype="<u4").tobytes()))
            yield _batch(rows, NAMES, TYPES)

    return run


def _first_seen(min_docs: int):
    """Stream a sorted partition.

    Rows come out with ``docs`` null where they are to be dropped for certain.
    Rows of the partition's first group, and of its last while fewer than
    ``min_docs`` documents were seen, come out open: ``docs`` is the number of
    documents that the row stands for in the group's total.  No more than the
    rows of ``min_docs`` documents are ever held.
    """

    def run(batches):
        names, types = ["docs", *NAMES], [pa.int32(), *TYPES]
        out: list[tuple] = []
        key = doc = None
        docs, first = 0, True
        keeper: list[tuple] = []
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[n].to_pylist() for n in NAMES)):
                if key != (row[0], row[1]):
                    first = key is None
                    key, docs, keeper, held = (row[0], row[1]), 0, [], []
                new = not docs or row[2] != doc
                docs, doc = docs + new, row[2]
                if first:
                    out.append((int(new), *row))
                elif docs == 1:
                    keeper.append((int(new), *row))
                elif docs < min_docs:
                    held.append((int(new), *row))
                else:
                    out += [(None, *r[1:]) for r in held]
                    held = []
                    out.append((None, *row))
                if len(out) >= CHUNK:
                    yield _batch(out, names, types)
                    out = []
        if keeper:  # the last group may go on in the next partition
            out += [(docs - sum(r[0] for r in held), *keeper[0][1:]), *((0, *r[1:]) for r in keeper[1:]), *held]
        yield _batch(out, names, types)

    return run


def _bitmaps(batches):
    for batch in batches:
        rows = []
        for doc, body, n, lists in zip(*(batch[c].to_pylist() for c in ("doc_id", "body", "n_lines", "lists"))):
            keep = np.ones(n, dtype=np.uint8)
            for at in lists:
                keep[np.frombuffer(at, dtype="<u4")] = 0
            packed = zstandard.ZstdCompressor(level=3).compress(np.packbits(keep, bitorder="little").tobytes())
            rows.append((doc, body, n, int(n - keep.sum()), packed))
        yield _batch(rows, ["doc_id", "body", "n_lines", "n_dropped", "keep"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, body, n_lines, n_dropped, keep) of every document that loses lines.

    ``docs`` has doc_id and text; ``body`` is Spark's xxhash64 of the text, which
    tells rows of one doc_id apart; ``keep`` is a zstandard frame of one bit per
    line, lowest bit first, 1 for lines that stay.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("body"), F.encode(text, "UTF-8").alias("text"))
    found = staged(narrow.mapInArrow(worker(_occurrences(min_chars)), OCCURRENCES), "lines")
    by = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("body")]
    ordered = found.repartitionByRange(*by).sortWithinPartitions(*by)
    seen = staged(ordered.mapInArrow(worker(_first_seen(min_docs)), f"docs int, {OCCURRENCES}"), "first-seen")
    drop_staged(found)
    open_rows = seen.filter("docs IS NOT NULL")
    # At most two hashes for each range partition.
    totals = open_rows.groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("keeper"))
    totals = totals.filter(F.col("n") >= min_docs).drop("n")
    late = open_rows.join(F.broadcast(totals), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    columns = ["doc_id", "body", "n_lines", "at"]
    drops = seen.filter("docs IS NULL").select(*columns).unionByName(late.select(*columns))
    per_doc = drops.groupBy("doc_id", "body").agg(F.max("n_lines").alias("n_lines"), F.collect_list("at").alias("lists"))
    return per_doc.mapInArrow(worker(_bitmaps), "doc_id long, body long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: bytes, n_lines: int | None, keep: bytes | None) -> bytes:
    """The text without its dropped lines."""
    if keep is None:
        return text
    bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), dtype=np.uint8), bitorder="little")
    return b"\n".join(line for line, bit in zip(text.split(b"\n"), bits[:n_lines].tolist()) if bit)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The numbered columns of ``docs`` with _doc, _bytes (UTF-8 of the text), n_lines, n_dropped and keep, null where nothing goes."""
    text = F.coalesce(at(docs, "text"), F.lit(""))
    d = numbered(docs).withColumns({"_doc": at(docs, "doc_id").cast("bigint"), "_body": F.xxhash64(text), "_bytes": F.encode(text, "UTF-8")})
    b = bitmaps.withColumnsRenamed({"doc_id": "_doc2", "body": "_body2"})
    joined = d.join(b, d["_doc"].eqNullSafe(b["_doc2"]) & (d["_body"] == b["_body2"]), "left")
    return joined.drop("_doc2", "_body2", "_body")


def _digests(batches):
    for batch in batches:
        rows = []
        for doc, text, n, dropped, keep in zip(*(batch[c].to_pylist() for c in ("_doc", "_bytes", "n_lines", "n_dropped", "keep"))):
            left = kept_lines(text, n, keep)
            rows.append((doc, text.count(b"\n") + 1, dropped or 0, hashlib.sha256(left).hexdigest()))
        yield _batch(rows, ["doc_id", "n_lines", "n_dropped", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def _kept_texts(batches):
    for batch in batches:
        texts = [kept_lines(*x).decode("utf-8", "replace") for x in zip(*(batch[c].to_pylist() for c in ("_bytes", "n_lines", "keep")))]
        rest = [c for c in batch.schema.names if c.startswith("_c")]
        yield pa.RecordBatch.from_arrays([batch[c] for c in rest] + [pa.array(texts, pa.string())], names=[*rest, "_kept"])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text`` (null texts stay null) and n_chars, if there, counted anew."""
    bounded_batches(docs.sparkSession)
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = f"_c{docs.columns.index('text')}"
    # The old text goes along as bytes only; whether it was null is all that is left of it.
    lean = marked.withColumn(text, F.when(F.col(text).isNotNull(), F.lit("")))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    done = lean.mapInArrow(worker(_kept_texts), f"{schema}, _kept string").withColumn(text, F.when(F.col(text).isNotNull(), F.col("_kept")))
    if "n_chars" in docs.columns:
        n = docs.columns.index("n_chars")
        done = done.withColumn(f"_c{n}", F.char_length(text).cast(docs.schema.fields[n].dataType))
    return done.select(*names).toDF(*docs.columns)


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    """Line counts and the kept text's SHA-256 of every document."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    marked = with_bitmaps(docs, keep_bitmaps(docs)).select("_doc", "_bytes", "n_lines", "n_dropped", "keep")
    return marked.mapInArrow(worker(_digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP9_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), shared AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
    GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE s.k IS NOT NULL AND l.doc_id <> s.keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE s.k IS NULL OR l.doc_id = s.keeper), '')) AS kept_sha256
FROM keyed l LEFT JOIN shared s ON l.k = s.k
GROUP BY l.doc_id
"""
