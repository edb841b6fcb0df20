"""Each training-data operator against brute force, with odd rows and empty tables."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxquarry.llm import bpe, components, fingerprints, langid, line_dedup, neighbours, packing, pretokens, sharding, simhash, subwords, token_files, warc
from voxquarry.llm.common import pick


def key(r):
    return (r[0] is not None, r[0] or 0)


def test_sharding(spark, docs, none, rows):
    def run(df):
        narrow = pick(df, "doc_id", "text").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"))
        return sharding.assign_shards(narrow, ["doc_id", "size"], "size", 4).collect()

    assert run(none) == []
    out = run(docs)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [key((r["doc_id"],)) for r in order] == sorted(key((r["doc_id"],)) for r in out)
    total, before = sum(r["size"] for r in out), 0
    for r in order:
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total))
        before += r["size"]
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=3):
    n = len(prints)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, none, rows):
    prints = simhash.add_fingerprint(docs)
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in prints.collect())
    small = [r for r in rows if r[0] != 405]
    want = [(r[0], fingerprint(r[1])) for r in small] + [(405, fingerprint("x" * 200_000))] * 2
    assert got == Counter(want)
    out = {r["fp"] & (2**64 - 1): r["component_id"] for r in simhash.classes(prints).collect()}
    roots = linked([w[1] for w in want])
    least = {}
    for (doc, _), root in zip(want, roots):
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    assert all(out[fp] == least.get(root) for (_, fp), root in zip(want, roots))
    assert simhash.classes(simhash.add_fingerprint(none)).collect() == []


def test_simhash_buckets_in_slices(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s for s in seeds}
    while len(fps) < 400:
        v = rng.choice(seeds)
        for _ in range(rng.randint(1, 5)):
            v ^= 1 << rng.randrange(64)
        fps.add(v)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(fps)], "doc_id long, fp long")
    want = Counter(linked(fps)).values()
    for bucket in (1024, 7):
        links = components.components(simhash.link_fingerprints(df, bucket=bucket))
        sizes = Counter(r["v"] for r in links.collect())
        assert sorted(n + 1 for n in sizes.values()) == sorted(n for n in want if n > 1)


def test_near_duplicates(spark, docs, none, rows):
    assert simhash.keep_one(none).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r[0] for r in kept.collect())
    assert ids[300] == 1 and not any(ids[i] for i in (301, 302, 303, 310, 311, 312))
    assert ids[405] == 1 and all(ids[r[0]] == 1 for r in rows[:120])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def tiktoken_encoding():
    ranks = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = "ab c  \n\t'sré漢字1²½̀​\xa0\x85\x1c　!?😀ßİΣ\0\r\x0b<|endoftext|>"


def odd_texts(n=3000):
    rng = random.Random(11)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_bpe(spark, docs, none, rows):
    ranks, encoding = tiktoken_encoding()
    own = bpe.Encoder(ranks, public.PATTERN)
    for text in odd_texts():
        assert "".join(pretokens.chunks(text)) == text
        assert own.encode(text) == encoding.encode_ordinary(text)
    long = "".join(random.Random(5).choice("abcdeé") for _ in range(60_000))
    assert own.encode(long) == encoding.encode_ordinary(long) and own.decode(own.encode(long)) == long.encode()
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in bpe.encode_texts(docs).collect())
    assert got == Counter((r[0], struct.pack(f"<{len(x)}I", *x)) for r in rows for x in [encoding.encode_ordinary(r[1] or "")])
    back = Counter((r["doc_id"], bytes(r["bytes"])) for r in bpe.decode_ids(bpe.encode_texts(docs)).collect())
    assert back == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert bpe.encode_texts(none).collect() == []


def test_bpe_forgets(rows):
    ranks, encoding = tiktoken_encoding()
    own = bpe.Encoder(ranks, public.PATTERN, remembered=5)
    assert all(own.encode(r[1] or "") == encoding.encode_ordinary(r[1] or "") for r in rows)


def test_bpe_merges_together_as_alone():
    ranks, encoding = tiktoken_encoding()
    own = bpe.Encoder(ranks, public.PATTERN)
    rng = random.Random(3)
    words = ["".join(rng.choice("aaabeé漢 ") for _ in range(rng.randint(1, 40))).encode() for _ in range(2000)]
    words = [w for w in dict.fromkeys(words) if w not in ranks]
    for got, word in zip(own.merge(words), words, strict=True):
        assert [got] == bpe.Encoder.merge(own, [word])
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == encoding._encode_single_piece(word)
    texts = odd_texts() + ["", "x" * (bpe.TOGETHER + 5), "", "ab " * 1000]
    assert list(own.encode_many(texts)) == [struct.pack(f"<{len(x)}I", *x) for x in map(encoding.encode_ordinary, texts)]


def test_bpe_merge_to_a_lower_rank():
    # "bc" is merged at 259, then "abc" has rank 257, which goes before the "bc" further right.
    ranks = {bytes([b]): b for b in range(256)} | {b"xx": 256, b"abc": 257, b"cb": 258, b"bc": 259, b"abcbc": 260}
    own = bpe.Encoder(ranks, r"\S+")
    encoding = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcbc", "abcabc", "bcabcbcxx", "bbcc", "abcabcbcabcab"):
        assert own.encode(text) == encoding.encode_ordinary(text), text


@pytest.mark.parametrize("name, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_subwords(name, words):
    own = subwords.Subwords(public.path(name), words)
    latin = [f(chr(c)) for c in [*range(0x20, 0x180), 9, 10, 13] for f in (str, lambda c: f"a{c}b", lambda c: f" {c}{c}", lambda c: f"A{c}1 .{c}'s")]
    for text in odd_texts() + latin:
        ids = own.library.encode(text, add_special_tokens=False).ids
        assert own.encode_bytes(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_warc(spark, none):
    rows = [(5, "http://a/ü b", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://c", None), (8, "x\r\ny", ""), (7, "http://d", "é" * 100_000), (None, "u", "alone"), (2, "v", "two"), (2, "v", "two"), (11, "w", "two")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    files = warc.write_archives(pages)
    normal = warc.normalise(files)
    got = Counter(map(tuple, warc.read_archives(normal).collect()))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i != first.get(h or "")
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first.get(h or "") if revisit else None] += 1
    assert got == want
    assert sum(r["records"] for r in normal.collect()) == len(rows) + files.count()
    assert warc.read_archives(warc.normalise(warc.write_archives(spark.createDataFrame([], pages.schema)))).collect() == []
    # members stand alone, and the whole is still one gzip file
    path = normal.first()["file"].removeprefix("file://")
    data = open(path, "rb").read()
    import gzip

    assert gzip.decompress(data).startswith(b"WARC/1.1")
    big = warc.read_archives(warc.normalise(warc.write_archives(pages, min_bytes=10_000))).collect()
    assert all(r["record_type"] == "response" for r in big if r["payload_bytes"] < 10_000)


def test_warc_refuses_damage():
    whole = warc.record(1, "u", b"abc", None, False)
    assert [h["warc-record-id"] for h, _ in warc.records(iter([whole[:10], whole[10:] + whole, b""]).__next__)] == ["<urn:x-page:1>"] * 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(iter([whole[:-3], b""]).__next__))


def brute_pieces(rows):
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    out = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out[r[0], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    return out


def test_packing(spark, docs, none, rows):
    report = []
    for size in (60_000, 20):
        out = packing.pack(packing.cut_documents(docs), per_partition=size, report=report).collect()
        assert Counter(tuple(r)[:5] for r in out) == brute_pieces(rows)
        places = {}
        for r in out:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for spans in places.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        assert report[-1][1] <= len(places) <= min(b for b, _ in report[-3:]) + 2
    assert packing.pack(packing.cut_documents(none)).collect() == []


def test_packing_bounds():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 9))])
        bins, offsets, rest = packing.best_fit_decreasing(lengths, 30)
        bound = packing.lower_bound(np.bincount(lengths, minlength=31))
        best = exact_bins(sorted(lengths.tolist(), reverse=True), 30)
        assert bound <= best <= len(rest)
        assert all(sum(lengths[bins == b]) + rest[b] == 30 for b in range(len(rest)))
    assert packing.lower_bound(np.bincount([16, 16, 16], minlength=31)) == 3


def exact_bins(items, size):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= size:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_language(spark, docs, none, rows):
    model = langid.learn(docs)
    assert sorted(model) == ["en", "fr"] and max(map(len, model.values())) <= langid.DICT_BYTES + langid.SAMPLE_DOCS
    out = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 120 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 10 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] for i in (400, 401, 402, 403, 406))
    kept = langid.confident(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} >= set(range(120))
    assert langid.learn(none) == {} and langid.confident(none).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_token_files(spark, docs, none, rows, tmp_path):
    files = token_files.write_ids(docs, folder=f"file://{tmp_path}")
    out = sorted(token_files.read_index(files).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((d, len(x), crc(x)) for d, x in ids)
    assert [key(r) for r in out] == sorted(key(r) for r in out)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.read_index(token_files.write_ids(none)).collect() == []
    from pyarrow import fs

    row = files.filter("docs > 3").first()
    path = row["file"].removeprefix("file://")
    with fs.LocalFileSystem().open_input_file(path) as source:
        reader = token_files.Reader(source)
        wanted = {d: x for d, x in ids if d is not None}
        assert reader.ids(2).tolist() == wanted[int(reader.docs[2])]
    data = bytearray(open(path, "rb").read())
    data[5] ^= 255
    broken = tmp_path / "broken"
    broken.write_bytes(bytes(data))
    with fs.LocalFileSystem().open_input_file(str(broken)) as source, pytest.raises(Exception):
        token_files.Reader(source).ids(0)


def brute_neighbours(vectors, step=50, k=5):
    out = {}
    for q, a in vectors.items():
        if q % step:
            continue
        scored = sorted(((-float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in vectors.items() if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=16) for i in range(900)}
    for i in range(300, 340):
        vectors[i] = vectors[300]
    bad = [(2000, None), (2050, [0.0] * 16), (2100, [math.nan] * 16), (2150, [None] * 16), (2200, [1.0, 2.0]), (None, [1.0] * 16), (2250, [])]
    rows = [(i, [float(x) for x in v], 1) for i, v in vectors.items()] + [(i, v, 2) for i, v in bad] + [(0, [float(x) for x in vectors[0]], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, raw int")
    out = neighbours.nearest(df, "vec_id", "embedding", lambda i: i % 50 == 0, leaf_size=60, degree=12, beam=64).collect()
    want = brute_neighbours(vectors)
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert abs(r["score"] - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert got[300] == [301, 302, 303, 304, 305]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.nearest(few, "vec_id", "embedding", lambda i: i % 50 == 0).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(few.limit(0), "vec_id", "embedding", lambda i: i % 50 == 0).collect() == []


def brute_lines(rows, min_chars=40, min_docs=5):
    def line_key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders.setdefault(line_key(line), set()).add(r[0])
    out = []
    for r in rows:
        kept = []
        for line in (r[1] or "").split("\n"):
            held = holders.get(line_key(line), ())
            largest = max((i for i in held if i is not None), default=None)
            if len(held) < min_docs or r[0] == largest:
                kept.append(line)
        out.append((r[0], "\n".join(kept)))
    return out


def test_lines(spark, docs, none, rows):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    want = Counter((i, t if r[1] is not None else None) for (i, t), r in zip(brute_lines(rows), rows))
    assert Counter((r[0], r[1]) for r in got.collect()) == want
    assert any(t != (r[1] or "") for (_, t), r in zip(brute_lines(rows), rows))
    assert line_dedup.dedup_lines(none).collect() == []
    assert all(r[4] == len(r[1]) for r in got.collect() if r[1] is not None)


def test_lines_shared_by_all(spark):
    line = "x" * 45
    rows = [(i, f"{line}\nown line {i}\n{line}" if i % 3 else line, None, None, None) for i in range(3000)] + [(None, line, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert Counter((r[0], r[1]) for r in line_dedup.dedup_lines(df).collect()) == Counter(brute_lines(rows))


def plain_likeness(a, b):
    n, p, q = max(len(a), len(b)), 0, 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    while q < min(len(a), len(b)) and a[-1 - q] == b[-1 - q]:
        q += 1
    return min(p + q, len(a), len(b)) / n if n else 1.0


def test_fingerprints(spark, docs, none, rows):
    assert fingerprints.fingerprint_neighbours(none).collect() == []
    out = fingerprints.fingerprint_neighbours(docs).collect()
    bodies = {t: b for t, b in spark.createDataFrame([((r[1] or ""),) for r in rows], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (*key(r), bodies[r[1] or ""]))
    want = Counter()
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = fingerprints.edited(a, b)
        want[r[0], len(a), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(a, e), 9), round(plain_likeness(a, b), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(by[405]) == 1 and len(set().union(*(by[i] for i in (300, 301, 302, 303)))) == 1
    assert len({r["fingerprint"] for r in out}) == len({r[1] or "" for r in rows})


def test_spans():
    rng = random.Random(9)
    a = "".join(rng.choice("ab") for _ in range(300))
    b = "".join(rng.choice("ab") for _ in range(280))
    x, y = fingerprints.Prefixes(fingerprints.code_points(a)), fingerprints.Prefixes(fingerprints.code_points(b))
    for _ in range(500):
        i, j = rng.randrange(300), rng.randrange(280)
        n = rng.randint(0, min(300 - i, 280 - j, 9))
        assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = x.extension(i, y, j)
        assert a[i : i + k] == b[j : j + k] and (i + k == 300 or j + k == 280 or a[i + k] != b[j + k])


def jaccard(a, b, words=5):
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def classes_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(df).collect()}


def test_near_duplicates_with_a_passage_changed(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, want = [], []
    for k in range(90):
        own = [word() for _ in range(350)]
        n = [18, 36, 52][k % 3] if k % 2 else [22, 40, 62, 84][k % 4]
        at = rng.randrange(0, 300 - n)
        other = own[:at] + [word() for _ in range(n)] + own[at + n :] if k % 2 else own + [word() for _ in range(n)]
        texts += [" ".join(own), " ".join(other)]
        want.append(jaccard(*texts[-2:]))
    assert sum(0.8 <= j < 0.95 for j in want) > 50 and sum(j < 0.8 for j in want) > 10
    got = classes_of(spark, texts)
    assert [got[2 * k] == got[2 * k + 1] for k in range(90)] == [j >= 0.8 for j in want]


def test_near_duplicates_count_a_shingle_once(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        line = " ".join(word() for _ in range(24))
        for _ in range(2):
            texts.append("\n".join([line] * 8 + [" ".join(word() for _ in range(100))]))
    got = classes_of(spark, texts)
    assert all(jaccard(a, b) < 0.3 for a, b in zip(texts[::2], texts[1::2]))
    assert len(set(got.values())) == len(texts)
    # and a passage repeated in one of two alike texts doesn't part them
    words = [word() for _ in range(200)]
    texts = [" ".join(words), " ".join(words + words[:100] * 6)]
    assert jaccard(*texts) > 0.8 and len(set(classes_of(spark, texts).values())) == 1


def test_language_rejects(spark):
    rng = random.Random(21)
    letters = {"aa": "abcdefghijklm", "bb": "hijklmnopqrst", "cc": "nopqrstuvwxyz"}
    lexicon = {x: ["".join(rng.choice(c) for _ in range(rng.randint(2, 8))) for _ in range(400)] for x, c in letters.items()}
    text = lambda x, n=200: " ".join(rng.choice(lexicon[x]) for _ in range(n))
    rows = [(i, text(x), x) for i, x in enumerate(["aa", "bb"] * 250)]
    taught = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    alone = langid.learn(spark.createDataFrame([r for r in rows if r[2] == "aa"], "doc_id long, text string, lang string"))
    classify, single = langid.Classifier(taught), langid.Classifier(alone)
    clean = [classify(text(x)) for x in ["aa", "bb"] * 100]
    assert sum(r for _, _, r in clean) <= 10 and [c[0] for c in clean] == ["aa", "bb"] * 100
    junk = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(200))
    odd = {"mixed": lambda: text("aa", 100) + " " + text("bb", 100), "gibberish": junk, "unlearned": lambda: text("cc")}
    for name, make in odd.items():
        assert sum(classify(make())[2] for _ in range(50)) >= 45, name
    assert sum(single(text("aa"))[2] for _ in range(100)) <= 5
    assert sum(single(junk())[2] for _ in range(50)) >= 45 and sum(single(text("cc"))[2] for _ in range(50)) >= 45


def parsed(text):
    """A fingerprint's cuts as written: (end, window hash, residue, residue); the last is the end of the text."""
    level, digits = text.split(":")
    numbers = [int(digits[i : i + 8], 16) for i in range(0, len(digits), 8)]
    return int(level, 16), [tuple(numbers[i : i + 4]) for i in range(0, len(numbers), 4)]


def brute_alike(one, other):
    """Share of the longer text in spans that both fingerprints have, by their strings alone."""
    (la, a), (lb, b) = parsed(one), parsed(other)
    level = max(la, lb)

    def spans(cuts):
        zero = lambda w: (((w * 0x9E3779B97F4A7C15) % 2**64) >> 32) % 2**level == 0
        kept = [(0, -1, 0, 0), *[c for c in cuts[:-1] if zero(c[1])], cuts[-1]]
        out = Counter()
        for x, y in zip(kept, kept[1:]):
            moved = [(y[2 + k] - x[2 + k]) * pow(fingerprints.BASES[k], -x[0], p) % p for k, p in enumerate(fingerprints.PRIMES)]
            out[x[1], y[0] - x[0], *moved] += 1
        return out

    x, y, longest = spans(a), spans(b), max(a[-1][0], b[-1][0])
    return sum(min(n, y[k]) * k[1] for k, n in x.items()) / longest if longest else 1.0


def brute_residues(text, n):
    return tuple(sum((ord(c) + 1) * pow(b, j, p) for j, c in enumerate(text[:n])) % p for b, p in zip(fingerprints.BASES, fingerprints.PRIMES))


def made(text):
    return fingerprints.Prefixes(fingerprints.code_points(text)).fingerprint()


def test_fingerprint_strings():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["", "a", "abcdefgh", "abcdefghi", "x" * 5000, "ab" * 700, text(4), text(30), text(400), text(3000)]
    for t in texts[:-1]:
        f = made(t)
        level, cuts = parsed(str(f))
        assert len(cuts) <= fingerprints.CUTS + 1 and cuts[-1][0] == len(t)
        assert all(brute_residues(t, c[0]) == c[2:] for c in cuts)
        assert str(fingerprints.Fingerprint.parse(str(f))) == str(f)
    pairs = [(a, b) for a in texts for b in texts]
    for _ in range(150):
        a = text(rng.choice([3, 20, 90, 500]))
        at, n = rng.randrange(len(a)), rng.randrange(1, 40)
        pairs.append((a, a[:at] + rng.choice(["", "Z", text(5), a[:80]]) + a[at + n :]))
        pairs.append((a, "<p>" + a + " end"))
        pairs.append((a, a[len(a) // 2 :] + a[: len(a) // 2]))
    for a, b in pairs:
        f, g = made(a), made(b)
        got = fingerprints.alike(f, g)
        assert got == pytest.approx(brute_alike(str(f), str(g)), abs=1e-12) and 0 <= got <= 1
        assert (got == 1.0) == (a == b) or len(a) < 100
        assert fingerprints.alike(fingerprints.Fingerprint.parse(str(f)), fingerprints.Fingerprint.parse(str(g))) == got
    # a character changed at each end, and a passage put in, cost little; other texts share nothing
    for n in (200, 1000, 3000):
        a = text(n)
        assert fingerprints.alike(made(a), made("#" + a[1:-1] + "#")) > 0.75
        assert fingerprints.alike(made(a), made(a[: len(a) // 3] + " put in here " + a[len(a) // 3 :])) > 0.75
        assert 0.35 < fingerprints.alike(made(a), made(fingerprints.edited(a, text(n)))) < 0.65
        other = " ".join("".join(rng.choice("hijklm") for _ in range(6)) for _ in range(n))
        assert fingerprints.alike(made(a), made(other)) == 0


def test_fingerprint_query_columns(spark, docs):
    out = fingerprints.fingerprint_neighbours(docs).collect()
    after = {}
    for r in out:
        assert r["alike_edited"] == pytest.approx(brute_alike(r["fingerprint"], r["edited_fingerprint"]), abs=1e-12)
        after.setdefault(r["doc_id"], r["fingerprint"])
    ids = sorted((i for i in after if i is not None and 0 <= i < 120))
    for r in out:
        if r["doc_id"] in ids[:-1]:
            assert r["alike_next"] == pytest.approx(brute_alike(r["fingerprint"], after[ids[ids.index(r["doc_id"]) + 1]]), abs=1e-12)


def test_neighbours_beyond_the_beam_lengths_and_clashes(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    vectors = {i: base + 0.001 * rng.normal(size=8) for i in range(300)}
    short = {i: rng.normal(size=3) for i in range(1000, 1040)}
    rows = [(i, [float(x) for x in v], "a", 1) for i, v in {**vectors, **short}.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_ID string, id int")
    out = neighbours.nearest(df, "vec_id", "embedding", lambda i: i % 50 == 0, k=100, beam=32).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 300, 50):
        assert len(got[q]) == 100 and len(set(got[q]) & set(brute_neighbours(vectors, k=100)[q])) >= 95
    assert got[1000] == brute_neighbours(short, k=39)[1000] and set(got[1000]) == set(short) - {1000}


def brute_language(model, text):
    """Fewest bytes of 512-byte segments, each on its own, by a dictionary for each language."""
    import zstandard

    if not text or not any(map(str.isalpha, text)):
        return "und"
    data = text.lower().encode()
    sizes = {}
    for lang, content in sorted(model.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(**langid.CODER)
        sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(data[i : i + 512])) for i in range(0, len(data), 512))
    return min(sizes, key=sizes.get)


def test_language_against_brute_force(spark, docs, rows):
    model = langid.learn(docs)
    out = langid.identify(docs, model, ["doc_id"]).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in out) == Counter((r[0], brute_language(model, r[1])) for r in rows if r[0] != 405) + Counter(
        {(405, brute_language(model, "x" * 200_000)): 2}
    )
    wide = spark.createDataFrame([("0123456789" * 2000,)], "t string").select(langid.windows(F.col("t"), 4, 10).alias("w")).first()["w"]
    assert wide.split("\n") == ["0123456789", "3456789012", "6789012345", "0123456789"]


def test_packing_exchanges_at_small_sizes(spark):
    rng = random.Random(17)
    pieces = [(i, 0, 0, rng.choice([900, 1000, 1100, 700, 500, 300]), 0) for i in range(60)]
    report = []
    out = packing.pack(spark.createDataFrame(pieces, packing.PIECE), report=report).collect()
    assert len({r["sequence_id"] for r in out}) == min(b for b, _ in report) <= report[0][1] + 2
