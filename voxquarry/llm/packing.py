"""Best-fit packing with certified bin counts.

Pieces of documents are dealt at random into packing partitions of bounded size.
Each is packed by best-fit decreasing, and dual-feasible functions of the piece
lengths give a number of sequences that no packing of the partition can go
below.  A partition that meets its bound is optimal and stays; those with a gap
give the pieces of all sequences that aren't full, and every partition those of
its emptiest one, into an exchange, where they are dealt anew and packed again.
Rounds end when the whole meets its bound, or a round brings nothing.  Whatever
its size, a table of two sequences or more is dealt to two partitions at least.

Per partition only its counts reach the driver; pieces stay on the executors,
where a partition holds ``PIECES`` rows of a few numbers.

Edge cases: null and empty texts are one piece of the end id alone; texts longer
than a sequence are cut into full pieces and a rest; repeated rows are packed as
documents of their own; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged, table, worker
from .subwords import subwords

LENGTH = 2048
PIECES = 60_000
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str, path: str | None, length: int, end_id: int):
    def run(batches):
        own, end = None, int(end_id).to_bytes(4, "little")
        for batch in batches:
            own = own or subwords(vocabulary, True, path)
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = own.encode_bytes(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, without their ids."""
    return pick(docs, "doc_id", "text").mapInArrow(worker(_cut(vocabulary, path, length, end_id), "subwords"), PIECE)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what is left free in each bin.

    Bins wait in lists by free space; a bitmap of the lists in use gives the
    smallest free space that is enough.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask, count = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            space, at = size, count
            count += 1
        bins[i], offsets[i] = at, size - space
        left = space - n
        if left:
            free[left].append(at)
            mask |= 1 << left
    rest = np.zeros(count, np.int64)
    for space, waiting in enumerate(free):
        rest[waiting] = space
    return bins, offsets, rest


def lower_bound(histogram: np.ndarray) -> int:
    """Bins of size ``len(histogram) - 1`` that items of these lengths need at least.

    The largest of the bounds of two families of dual-feasible functions: one
    counts items over size - t as a whole bin and drops those under t, the other
    rounds lengths to k parts of a bin.
    """
    size = len(histogram) - 1
    lengths = np.arange(size + 1, dtype=np.int64)
    best = -(-int((histogram * lengths).sum()) // size)
    counts = np.concatenate([[0], np.cumsum(histogram)])  # items shorter than i
    sums = np.concatenate([[0], np.cumsum(histogram * lengths)])
    t = np.arange(1, size // 2 + 1)
    whole = counts[-1] - counts[size - t + 1]
    middle = sums[size - t + 1] - sums[t]
    best = max(best, int((whole + -(-middle // size)).max(initial=0)))
    for k in range(2, 65):
        scaled = lengths * (k + 1)
        value = np.where(scaled % size == 0, lengths * k, (scaled // size) * size)
        best = max(best, -(-int((histogram * value).sum()) // (k * size)))
    return best


def _pack(size: int, turn: int):
    """Pack a partition; rows go out with sequence, offset, and whether their sequence is offered for exchange."""

    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if batches else None
        if rows is None or not rows.num_rows:
            return
        part = TaskContext.get().partitionId()
        lengths = rows["length"].to_numpy()
        bins, offsets, rest = best_fit_decreasing(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1))
        gap = len(rest) - bound
        offered = rest > 0 if gap else np.zeros(len(rest), bool)
        emptiest = int(rest.argmax())
        offered[emptiest] = rest[emptiest] > 0
        columns = [rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "offered", "bins", "bound"]
        sequence = (np.int64(turn) << 56) | (np.int64(part) << 28) | bins
        marks = np.zeros(len(bins), np.int64)
        marks[0] = len(rest)
        bounds = np.zeros(len(bins), np.int64)
        bounds[0] = bound
        done = pa.table([*columns, pa.array(sequence), pa.array(offsets), pa.array(offered[bins]), pa.array(marks), pa.array(bounds)], names=names)
        yield from done.to_batches(max_chunksize=10_000)

    return run


PACKED = f"{PIECE}, sequence_id long, offset long, offered boolean, bins long, bound long"


def pack(pieces: DataFrame, size: int = LENGTH, per_partition: int = PIECES, report: list | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``report`` gets (bins, bound) of the whole after each round."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = staged(pieces, "pieces")
    n = pieces.count()
    if not n:
        return pieces.select(*columns[:5], F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    histogram = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row for each length
        histogram[row["length"]] = row["count"]
    bound = lower_bound(histogram)
    kept: list[DataFrame] = []
    turn, todo, settled = 0, pieces, 0
    best = None
    while True:
        # What makes two sequences or more starts in two partitions at least; what is exchanged meets again.
        parts = max(-(-n // per_partition), 1 if kept or bound < 2 else 2)
        packed = staged(todo.repartition(parts).mapInArrow(worker(_pack(size, turn)), PACKED), "packed")
        # The counts ride on one row of each partition: the whole is settled by adding them up.
        total = packed.agg(
            F.sum("bins").alias("bins"), F.countDistinct(F.when(F.col("offered"), F.col("sequence_id"))).alias("loose"),
            F.sum(F.col("offered").cast("bigint")).alias("rows"),
        ).first()
        bins = settled + total["bins"]
        if report is not None:
            report.append((bins, bound))
        if best is not None and bins >= best[0]:
            return best[1]
        whole = packed if not kept else None
        result = packed.select(*columns)
        for part in kept:
            result = result.unionByName(part)
        best = (bins, result)
        if bins <= bound or parts == 1 and whole is not None or not total["rows"] or total["loose"] < 2:
            return result
        kept.append(packed.filter("NOT offered").select(*columns))
        settled = bins - total["loose"]
        todo, n, turn = packed.filter("offered").select(*columns[:5]), total["rows"], turn + 1


def op5_packing(spark, sf_dir) -> DataFrame:
    """All documents in as few sequences of 2048 ids as best fit finds."""
    return pack(cut_documents(table(spark, sf_dir, "documents")))
