"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens that are not known yet are merged many at once.  Their mergeable
pairs wait in buckets, one for each merge rank, that hold positions in one linked
list of the token starts.  Two levels of bitmaps say which buckets are filled;
find-first-set on the upper level and then on the lower one gives the lowest rank
in constant time, and the positions of its bucket are merged from left to right.
An entry whose pair has changed meanwhile is stale and is skipped.  A free place
between pre-tokens, which pairs with nothing, keeps them apart, and since the
lowest rank of all is also the lowest of each pre-token that holds it, each is
merged as it would be alone.  Very long pre-tokens thus cost n log n and short
ones little.

Edge cases: null and empty texts have no ids; texts of any length are encoded
whole; the result of a row depends on its text only, so repeated rows agree;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHES, pick, table, worker
from .pretokens import Memory, chunks

#: Bytes of chunks, and half as many of pre-tokens, remembered by a worker.
REMEMBERED = 128 << 20
#: Characters of texts that are encoded together (a longer text alone), and bytes of pre-tokens merged at once.
TOGETHER = 1 << 20
WORD = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank, the lowest rank first."""

    def __init__(self, ranks: int):
        self.leaf = [0] * (ranks // WORD + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.leaf[rank >> 8] |= 1 << (rank & 255)
        self.top |= 1 << (rank >> 8)

    def pop(self) -> tuple[int, list[int]]:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.leaf[word]
        low = bits & -bits
        rank = (word << 8) | (low.bit_length() - 1)
        self.leaf[word] = bits ^ low
        if bits == low:
            self.top ^= 1 << word
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes and decodes with merge ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.none = max(ranks.values()) + 1  # the free place between pre-tokens
        self.shift = self.none.bit_length()
        self.queue = RankQueue(self.none)
        #: Rank of what two neighbouring tokens make, by (left << shift) | right.
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        #: The same for two bytes, -1 where they make nothing; 256 stands for the free place.
        self.single = np.array([*(ranks[bytes([b])] for b in range(256)), self.none], np.int64)
        self.double = np.array([self.pairs.get(a << self.shift | b, -1) for a in self.single.tolist() for b in self.single.tolist()], np.int64)
        self.known: Memory = Memory(None, remembered)
        self.pieces: Memory = Memory(None, remembered // 2)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, which are not empty."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        places = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(pieces) + 1), lengths)
        letters = np.full(lengths.sum() + len(pieces) + 1, 256, np.int64)
        letters[places] = np.frombuffer(b"".join(pieces), np.uint8)
        ranks = np.append(self.double[letters[:-1] * 257 + letters[1:]], -1)
        token = self.single[letters].tolist()
        pair = ranks.tolist()  # rank of the pair that starts here, -1 if it can't merge or the start is gone
        after, before = list(range(1, len(pair) + 1)), list(range(-1, len(pair) - 1))
        queue, shift, rank_of = self.queue, self.shift, self.pairs.get
        buckets, put = queue.buckets, queue.put
        waiting = np.flatnonzero(ranks >= 0)
        waiting = waiting[np.argsort(ranks[waiting], kind="stable")]
        found, first = np.unique(ranks[waiting], return_index=True)
        for r, positions in zip(found.tolist(), np.split(waiting, first[1:])):
            put(r, positions.tolist())
        while buckets:
            rank, bucket = queue.pop()
            bucket.sort()
            base, lower, rest = rank << shift, False, iter(bucket)
            for i in rest:
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[i] = after[gone]
                before[end] = i
                token[i], token[gone], pair[gone] = rank, -1, -1
                r = rank_of(base | token[end])
                if r is None:
                    pair[i] = -1
                else:
                    pair[i] = r
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        put(r, [i])
                        lower = r < rank
                left = before[i]
                r = rank_of(token[left] << shift | rank)
                if r is None:
                    pair[left] = -1
                else:
                    pair[left] = r
                    if r in buckets:
                        buckets[r].append(left)
                    else:
                        put(r, [left])
                        lower = lower or r < rank
                if lower:  # goes first; the rest of this bucket waits
                    left_over = list(rest)
                    if left_over:
                        put(rank, left_over)
        ids = np.array(token, np.int64)
        alive = (ids >= 0) & (ids != self.none)
        out = ids[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive)[np.cumsum(lengths + 1) - 1]).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens."""
        out, new = {}, []
        for piece in pieces:
            ids = self.pieces.find(piece)
            if ids is None:
                new.append(piece)
            else:
                out[piece] = ids
        raw = [piece.encode("utf-8", "replace") for piece in new]
        apart = []
        for piece, letters in zip(new, raw):
            whole = self.ranks.get(letters)
            if whole is None:
                apart.append((piece, letters))
            else:
                out[piece] = whole.to_bytes(4, "little")
        group = [n // TOGETHER for n in accumulate(len(letters) for _, letters in apart)]
        a = 0
        while a < len(apart):
            b = bisect_right(group, group[a], a)
            out.update(zip((piece for piece, _ in apart[a:b]), self.merge([letters for _, letters in apart[a:b]])))
            a = b
        for piece in new:
            self.pieces.keep(piece, out[piece])
        return out

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what the texts share is looked up once."""
        parts = [chunks(text) for text in texts]
        ids, new = {"": b""}, []
        for chunk in set().union(*parts):
            at_hand = self.known.find(chunk)
            if at_hand is None:
                new.append(chunk)
            else:
                ids[chunk] = at_hand
        split = [self.find(chunk) for chunk in new]
        of = self._learn(list({piece for pieces in split for piece in pieces})).__getitem__
        for chunk, pieces in zip(new, split):
            ids[chunk] = of(pieces[0]) if len(pieces) == 1 else b"".join(map(of, pieces))
            self.known.keep(chunk, ids[chunk])
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def encode_many(self, texts: list[str]):
        """Ids of each text as little-endian unsigned 32-bit integers, in groups of some size."""
        group, held = [], 0
        for text in texts:
            if group and held + len(text) > TOGETHER:
                yield from self.encode_group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            yield from self.encode_group(group)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_group([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}
CACHES["bpe"] = _encoders.clear


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary, made once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers as public

    return path or public.path("byte_bpe_multi_50k.tiktoken"), pattern or public.PATTERN


def _encode(path: str | None, pattern: str | None):
    def run(batches):
        own = encoder(*_vocabulary(path, pattern))
        for batch in batches:
            ids = list(own.encode_many([t or "" for t in batch["text"].to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(ids, pa.binary())], names=[*(c for c in batch.schema.names if c != "text"), "ids"])

    return run


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in a binary."""
    return pick(docs, "doc_id", "text").mapInArrow(worker(_encode(path, pattern), "bpe"), "doc_id long, ids binary")


def _decode(path: str | None, pattern: str | None):
    def run(batches):
        own = encoder(*_vocabulary(path, pattern))
        for batch in batches:
            raw = [own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return run


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of the texts that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(worker(_decode(path, pattern), "bpe"), "doc_id long, bytes binary")


def _round_trip(path: str | None, pattern: str | None):
    def run(batches):
        own = encoder(*_vocabulary(path, pattern))
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"].to_pylist()]
            for doc, ids in zip(batch["doc_id"].to_pylist(), own.encode_many(texts)):
                raw = own.decode(np.frombuffer(ids, dtype="<u4").tolist())
                rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op3_byte_bpe(spark, sf_dir) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded in one pass."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.mapInArrow(worker(_round_trip(None, None), "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
