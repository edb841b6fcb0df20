"""WARC archives: writing, normalising monolithic gzip files, and indexed reading.

Pages become WARC/1.1 records.  Of records with equal payloads the one with the
smallest page_id is the response and the others are revisits that carry headers
only; that choice is an aggregate and a join on the payload's digest.  Every
partition writes one archive, compressed as a single gzip stream, as some
crawlers leave them: to read one record all before it must be inflated.

The normaliser inflates each such file once, from front to back, rewrites every
record as a gzip member of its own and writes a sidecar index with each
member's offset and length.  Records are then read by offset.

Files get new names in every attempt of a task and only those that a finished
task reports are used.  Memory per task is a record and a read buffer.

Edge cases: a null payload is empty; payloads under ``min_bytes`` are always
responses; a null page_id is a revisit of any equal payload with an id, and a
response otherwise; repeated rows of the smallest page_id are all responses; an
empty table writes no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, pick, staged, table, worker

LEVEL = 5
READ = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record with its trailing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]') if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_uri(first)}", f"WARC-Profile: {PROFILE}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(pull):
    """Whole records as (headers, raw bytes) from a stream; ``pull()`` gives more bytes, or none at the end."""
    held, done = bytearray(), False
    while True:
        at = held.find(END)
        while at < 0 and not done:
            more = pull()
            done = not more
            seen = max(0, len(held) - 3)
            held += more
            at = held.find(END, seen)
        if at < 0:
            if held.strip():
                raise ValueError("the archive ends within a header")
            return
        headers = parse_headers(bytes(held[:at]))
        if not headers[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {headers['']!r:.40}")
        size = at + 4 + int(headers["content-length"]) + 4
        while len(held) < size and not done:
            more = pull()
            done = not more
            held += more
        if len(held) < size:
            raise ValueError("the archive ends within a record")
        raw = bytes(held[:size])
        if not raw.endswith(END):
            raise ValueError("a record isn't followed by two blank lines")
        del held[:size]
        yield headers, raw


def _inflated(source):
    """``pull`` for :func:`records` over gzip data, of one member or many."""
    state = {"z": zlib.decompressobj(31), "rest": b"", "end": False}

    def pull() -> bytes:
        while not state["end"]:
            data = state["rest"] or source.read(READ)
            if not data:
                state["end"] = True
                if not state["z"].eof:
                    raise ValueError("the gzip stream is cut off")
                return b""
            if state["z"].eof:
                state["z"] = zlib.decompressobj(31)
            out = state["z"].decompress(data, 4 * READ)
            state["rest"] = state["z"].unused_data if state["z"].eof else state["z"].unconsumed_tail
            if out:
                return out
        return b""

    return pull


def _digested(batches):
    """Payloads compressed for the shuffle, with their digest and size."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        payloads = batch["payload"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch["page_id"], batch["url"], pa.array(map(pack, payloads), pa.binary()),
                pa.array([hashlib.sha1(p).digest() for p in payloads], pa.binary()), pa.array(map(len, payloads), pa.int64()),
            ],
            names=["page_id", "url", "packed", "sha1", "size"],
        )


def _write(folder: str):
    def run(batches):
        sink = stream = path = None
        count = 0
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for page, url, packed, first, revisit in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "packed", "first", "revisit"))):
                if sink is None:
                    store, top = fs.FileSystem.from_uri(folder)
                    store.create_dir(top, recursive=True)
                    path = f"whole-{uuid.uuid4().hex}.warc.gz"
                    sink, stream = store.open_output_stream(f"{top}/{path}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    info = b"software: voxquarry\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}"
                    sink.write(stream.compress(head.encode() + END + info + END))
                sink.write(stream.compress(record(page, url, unpack(packed), first, revisit)))
                count += 1
        if sink is not None:
            sink.write(stream.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([count], pa.int64())], names=["file", "records"])

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives; (file, records) of each."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"))
    rows = rows.mapInArrow(worker(_digested), "page_id long, url string, packed binary, sha1 binary, size long")
    narrow = pick(pages, "page_id", "html").select("page_id", F.unhex(F.sha1(payload)).alias("sha1"))
    firsts = narrow.groupBy("sha1").agg(F.min("page_id").alias("first"))
    joined = rows.join(firsts, "sha1").withColumn("revisit", (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")))
    written = joined.select("page_id", "url", "packed", "first", "revisit").mapInArrow(worker(_write(folder)), "file string, records long")
    return staged(written, "warc-files")


def _normalise(folder: str):
    def run(batches):
        for batch in batches:
            for uri in batch["file"].to_pylist():
                source_store, source_path = fs.FileSystem.from_uri(uri)
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top, recursive=True)
                name = f"records-{uuid.uuid4().hex}.warc.gz"
                offset = count = 0
                with (
                    source_store.open_input_file(source_path) as source,
                    store.open_output_stream(f"{top}/{name}", compression=None) as sink,
                    store.open_output_stream(f"{top}/{name}.idx", compression=None) as index,
                ):
                    for headers, raw in records(_inflated(source)):
                        coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = coder.compress(raw) + coder.flush()
                        sink.write(member)
                        line = {"offset": offset, "length": len(member), "id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "uri": headers.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                        count += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["file", "records"])

    return run


def _spread(files: DataFrame) -> DataFrame:
    """A task for each file; the list has a row for each archive."""
    listed = [(r["file"],) for r in files.select("file").collect()]
    return files.sparkSession.createDataFrame(listed, "file string").repartition(max(1, len(listed)))


def normalise(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrite gzip archives (column file) with a member per record and a sidecar ``.idx``; (file, records)."""
    folder = folder or new_folder(files.sparkSession, "warc")
    return staged(_spread(files).mapInArrow(worker(_normalise(folder)), "file string, records long"), "warc-files")


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record whose member lies there."""
    raw = zlib.decompress(source.read_at(length, offset), 31)
    head, _, rest = raw.partition(END)
    headers = parse_headers(head)
    return headers, rest[: int(headers["content-length"])]


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for uri in batch["file"].to_pylist():
            store, path = fs.FileSystem.from_uri(uri)
            rows = []
            with store.open_input_file(path) as source, store.open_input_stream(f"{path}.idx", compression=None) as index:
                tail = b""
                while chunk := index.read(READ):
                    *lines, tail = (tail + chunk).split(b"\n")
                    for line in lines:
                        entry = json.loads(line)
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        headers, block = read_member(source, entry["offset"], entry["length"])
                        http, _, payload = block.partition(END)
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        revisit = entry["type"] == "revisit"
                        if not revisit and digest(payload) != said:
                            raise ValueError(f"{entry['id']}: the payload doesn't match its digest")
                        size = int(parse_headers(http)["content-length"])
                        rows.append((_page_of(entry["id"]), size, said, entry["type"], _page_of(headers["warc-refers-to"]) if revisit else None))
                        if len(rows) >= 5000:
                            yield out(rows)
                            rows = []
            if rows:
                yield out(rows)


def read_archives(files: DataFrame) -> DataFrame:
    """One row per response or revisit record of normalised archives, read through their indexes."""
    return _spread(files).mapInArrow(worker(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark, sf_dir) -> DataFrame:
    """All pages written, normalised and read back."""
    return read_archives(normalise(write_archives(table(spark, sf_dir, "pages"))))


OP4_SQL = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p),
chunks AS (
    SELECT page_id, g, CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) AS v FROM f, (SELECT unnest(range(0, 8)) AS g)
), text AS (
    SELECT page_id, string_agg(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1),
        '' ORDER BY g) AS payload_digest
    FROM chunks GROUP BY page_id
)
SELECT f.page_id, f.payload_bytes, t.payload_digest,
       CASE WHEN f.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM f JOIN text t ON f.page_id = t.page_id
"""
