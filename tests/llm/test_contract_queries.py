"""The registered queries' columns, types and digests over a small written corpus."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers as public
import pytest
from test_operators import brute_lines, brute_pieces, fingerprint, tiktoken_encoding
from tokenizers import Tokenizer

from voxquarry.llm import registry

COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    "op7_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op10_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    pages = [(i, f"http://h/{i}", None if i % 9 == 0 else f"<p>{i % 4}</p>") for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    vectors = [(i, [float((i * 7 + j * j) % 11), float(i % 5), 1.0], 0) for i in range(120) for j in [i % 3]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


@pytest.fixture(scope="module")
def results(spark, sf):
    out = {}
    for name, fn in registry.QUERIES.items():
        df = fn(spark, sf)
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
        out[name] = df.collect()
    return out


def test_documents_are_whole(results, rows):
    for name in ("op1_sharding", "op2_simhash", "op3_byte_bpe", "op6_langid", "op7_token_files", "op9_line_dedup", "op10_fingerprints"):
        assert Counter(r["doc_id"] for r in results[name]) == Counter(r[0] for r in rows), name


def test_digests(results, rows):
    _, encoding = tiktoken_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in results["op1_sharding"]) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    want = Counter()
    for r in rows:
        ids = encoding.encode_ordinary(r[1] or "")
        want[r[0], len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((r[1] or "").encode())] += 1
    assert Counter(map(tuple, results["op3_byte_bpe"])) == want
    assert Counter((r["doc_id"], r["fingerprint"]) for r in results["op2_simhash"]) == Counter((r[0], f"{fingerprint(r[1]):016x}") for r in rows)
    assert Counter(tuple(r)[:5] for r in results["op5_packing"]) == brute_pieces(rows)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in results["op7_token_files"]) == Counter(
        (d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, x in ids
    )
    kept = Counter((i, (r[1] or "").count("\n") + 1, sha(t.encode())) for (i, t), r in zip(brute_lines(rows), rows))
    assert Counter((r["doc_id"], r["n_lines"], r["kept_sha256"]) for r in results["op9_line_dedup"]) == kept
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in results["op6_langid"])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(results, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    if name == "op9_line_dedup":  # the SQL takes doc_id for a key
        c.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM (SELECT * FROM '" + sf + "/documents.parquet/*.parquet') WHERE doc_id <> 405")
    got = Counter(tuple(r) for r in results[name] if name != "op9_line_dedup" or r["doc_id"] not in (None, 405))
    assert got == Counter(c.sql(registry.ORACLES[name]).fetchall())


def test_shards_are_cut_at_equal_targets(results):
    out = results["op1_sharding"]
    order = sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    total, before, places = sum(r["size"] for r in out), 0, Counter()
    for r in order:
        assert r["shard"] == min(15, (2 * before + r["size"]) * 16 // (2 * total)) and r["grown_shard"] is None and r["law"] == "bytes"
        if r["doc_id"] != 405:  # repeated rows may change places
            assert r["slot"] == places[r["shard"]]
        places[r["shard"]] += 1
        before += r["size"]
