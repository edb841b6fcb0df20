"""Token-id files: independent zstandard frames with a trailing seek table.

Layout of a file, which is also a valid zstandard stream:

* data frames, each ``FRAME_IDS`` ids (the last fewer) as little-endian unsigned
  16- or 32-bit integers, compressed on their own and with zstandard's checksum;
* a skippable frame with the document index: the compressed arrays of doc_ids,
  null marks and first id of each document;
* a skippable frame with the seek table of zstandard's public seekable format:
  for each frame its compressed and decompressed size and the low 32 bits of the
  XXH64 of its content, then the number of frames, a flag byte and a magic number.

A reader takes the two tables from the end of a file and then fetches and
decompresses only the frames that hold the wanted documents.

A narrow scan of (document id, text hash, bytes) says how many files there are, about
``FILE_BYTES`` of text each, and where each begins.  Texts are tokenised where they
lie; only their ids are shuffled, to the file they belong to.  Each partition streams
into one file, holding a frame and the index, not the ids.  File names are new for
every attempt of a task, and only files that a finished task reports are read, so
lost executors and repeated attempts leave the result alone.

Edge cases: null and empty texts are documents with the end id only; null ids
sort first; repeated rows are documents of their own, side by side; an empty
table writes no file and reads back no row; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_staged, new_folder, pick, staged, table, worker
from .subwords import subwords

FRAME_IDS = 32_768
#: Bytes of text for a file: what one task sorts and writes.
FILE_BYTES = 64 << 20
#: Bytes of the ids' chunks that a worker remembers.
REMEMBERED = 192 << 20
LEVEL = 3
INDEX_MAGIC = 0x184D2A51
SEEK_SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, sink, wide: bool):
        self.sink, self.kind = sink, np.dtype("<u4" if wide else "<u2")
        self.coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.null: list[bool] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.starts.append(self.total)
        self.total += len(ids)
        at = 0
        while at < len(ids):
            part = ids[at : at + FRAME_IDS - self.held]
            self.pending.append(part.astype(self.kind))
            self.held += len(part)
            at += len(part)
            if self.held == FRAME_IDS:
                self._frame()

    def _frame(self) -> None:
        raw = b"".join(x.tobytes() for x in self.pending)
        packed = self.coder.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = struct.pack("<BQ", self.kind.itemsize, len(self.docs))
        index += np.array(self.docs, dtype="<i8").tobytes() + np.array(self.null, dtype="u1").tobytes()
        index += np.array([*self.starts, self.total], dtype="<u8").tobytes()
        packed = struct.pack("<I", xxhash.xxh64_intdigest(index) & 0xFFFFFFFF) + zstandard.ZstdCompressor(level=LEVEL).compress(index)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        table_bytes = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_SKIPPABLE, len(table_bytes)) + table_bytes)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        foot = source.read_at(9, size - 9)
        frames, flags, magic = struct.unpack("<IBI", foot)
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table")
        entries = np.frombuffer(source.read_at(12 * frames, size - 9 - 12 * frames), dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.sums = entries[:, 2]
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", source.read_at(8, at))
        packed = source.read_at(length, at + 8)
        index = zstandard.ZstdDecompressor().decompress(packed[4:])
        if magic != INDEX_MAGIC or xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != struct.unpack("<I", packed[:4])[0]:
            raise ValueError("damaged document index")
        width, n = struct.unpack("<BQ", index[:9])
        self.kind = np.dtype(f"<u{width}")
        self.docs = np.frombuffer(index, dtype="<i8", count=n, offset=9)
        self.null = np.frombuffer(index, dtype="u1", count=n, offset=9 + 8 * n)
        self.starts = np.frombuffer(index, dtype="<u8", count=n + 1, offset=9 + 9 * n).astype(np.int64)
        self.at, self.frame = -1, np.zeros(0, self.kind)

    def _frame(self, k: int) -> np.ndarray:
        if k != self.at:
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(b - a, a))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.at, self.frame = k, np.frombuffer(raw, dtype=self.kind)
        return self.frame

    def ids(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document."""
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        parts = []
        while a < b:
            frame = a // FRAME_IDS
            low = a - frame * FRAME_IDS
            part = self._frame(frame)[low : low + b - a]
            parts.append(part)
            a += len(part)
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)


def _place(doc: int | None, body: int) -> tuple:
    return (doc is not None, doc or 0, body)


def _tokenise(heads: list[tuple], vocabulary: str, path: str | None, end_id: int, wide: bool):
    """(part, doc_id, body, ids) of each text: the file it belongs to, and its ids as they stand there."""

    def run(batches):
        own, kind = subwords(vocabulary, False, path, REMEMBERED), np.dtype("<u4" if wide else "<u2")
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            docs, bodies = batch["doc_id"].to_pylist(), batch["body"].to_pylist()
            parts = [max(bisect_right(heads, _place(d, b)) - 1, 0) for d, b in zip(docs, bodies)]
            ids = [own.encode_bytes(t or "") for t in batch["text"].to_pylist()]
            ids = [(x if wide else np.frombuffer(x, dtype="<u4").astype(kind).tobytes()) + end for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch["doc_id"], batch["body"], pa.array(ids, pa.binary())], names=["part", "doc_id", "body", "ids"])

    return run


def _write(folder: str, wide: bool):
    def run(batches):
        now, name, writer, sink = None, None, None, None
        kind = np.dtype("<u4" if wide else "<u2")

        def closed():
            writer.close()
            sink.close()
            row = [now], [f"{folder}/{name}"], [len(writer.docs)], [writer.total]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], names=["part", "file", "docs", "ids"])

        for batch in batches:
            for part, doc, ids in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]):
                if part != now:
                    if writer is not None:
                        yield closed()
                    now, (store, top) = part, _open(folder)
                    store.create_dir(top, recursive=True)
                    name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
                    sink = store.open_output_stream(f"{top}/{name}", compression=None)
                    writer = Writer(sink, wide)
                writer.add(doc, np.frombuffer(ids.as_buffer(), dtype=kind))
        if writer is not None:
            yield closed()

    return run


def write_ids(
    docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None, end_id: int = END_ID, wide: bool = False, folder: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; (part, file, docs, ids) of each file.

    ``wide`` takes 32-bit ids, for vocabularies over 65,536.  A file holds about
    ``file_bytes`` of text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "ids")
    marked = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("body"), "text")
    narrow = staged(marked.select("doc_id", "body", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")), "order")
    total = narrow.agg(F.sum("size")).first()[0]
    by = [F.col("doc_id").asc_nulls_first(), F.col("body")]
    ranges = narrow.repartitionByRange(-(-(total or 0) // file_bytes) or 1, *by)
    firsts = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "body")).alias("head"))
    # One row for each file.
    heads = sorted(_place(r["head"]["doc_id"], r["head"]["body"]) for r in firsts.collect())
    drop_staged(narrow)
    tokens = marked.mapInArrow(worker(_tokenise(heads, vocabulary, path, end_id, wide), "subwords"), "part int, doc_id long, body long, ids binary")
    placed = tokens.repartitionById(max(1, len(heads)), "part").sortWithinPartitions("part", *by)
    return staged(placed.drop("body").mapInArrow(worker(_write(folder, wide)), "part int, file string, docs long, ids long"), "id-files")


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
            store, path = _open(uri)
            with store.open_input_file(path) as source:
                reader = Reader(source)
                n = len(reader.docs)
                for low in range(0, n, 4096):
                    some = range(low, min(n, low + 4096))
                    sums = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in some]
                    lengths = np.diff(reader.starts[low : some.stop + 1])
                    docs = pa.array(reader.docs[low : some.stop], pa.int64(), mask=reader.null[low : some.stop].astype(bool))
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array(reader.starts[low : some.stop] + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def read_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves.

    Only the file list, one row for each range partition, passes the driver.
    """
    spark = files.sparkSession
    start, listed = 0, []
    for row in files.orderBy("part").collect():
        listed.append((row["file"], start))
        start += row["ids"]
    todo = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)))
    return todo.mapInArrow(worker(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir) -> DataFrame:
    """Every document's place and checksum, read back from the id files."""
    return read_index(write_ids(table(spark, sf_dir, "documents")))
