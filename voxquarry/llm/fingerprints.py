"""Document fingerprints from prefix polynomial hashes.

For a text c_0 c_1 ... the prefix arrays hold, for two primes p,
H[k] = sum of (c_j + 1) * B^j for j < k, modulo p.  Two spans are equal (but for
a collision of both residues) exactly if the differences of their ends, brought
to one power of B, agree; so any span equality takes constant time, and binary
search over lengths finds the longest common extension from any two places, to
the right or to the left.

The printed fingerprint is a sample of the prefix arrays: the length, the residues of
the whole, and those of the prefixes that end at cuts.  A cut ends a window of
``WINDOW`` code points whose hash has ``level`` zero bits, where ``level`` is the least
(``BASE_LEVEL`` at least) that leaves ``CUTS`` cuts or fewer; so cuts move with the
content, and those of a higher level are some of those of a lower one.  From two
fingerprints alone, :func:`alike` tells which spans between cuts are equal: it anchors
on a span that both have, finds the longest common extension from there by binary
search, and goes on behind the mismatch.  The likeness is the share of the longer text
that such spans cover, each used once.

``near_edited`` and ``near_next`` of the operator are measured on the whole prefix
arrays instead: the part of the longer text that the longest common prefix and, beyond
it, the longest common suffix cover.

``fingerprint_neighbours`` compares each document with the next in ascending
(doc_id, text hash) order.  Only (doc_id, text hash) is sorted to learn where
each range partition begins; texts then go once, compressed, to their partition,
the first of each partition to the one before it as well.

Edge cases: a null or empty text has no code point, and two such are alike (1.0),
while an empty and another text are not (0.0); a null doc_id comes first; repeated rows follow
one another; a single document is its own next; an empty table gives an empty
result; other columns are not read.  A text takes about 40 bytes of memory for
each code point while it is compared.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, bounded_batches, drop_staged, pick, shuffle_width, staged, table, worker

#: Two primes under 2**31, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 911382323)
#: Code points of a window, cuts of a fingerprint at most, and the lowest level of cuts.
WINDOW, CUTS, BASE_LEVEL = 8, 32, 2

_powers: list[np.ndarray] = [np.ones(1, np.int64)] * 4



def _forget() -> None:
    _powers[:] = [np.ones(1, np.int64)] * 4


CACHES["powers"] = _forget


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^(n-1) at least, or their inverses modulo the prime."""
    at, p = which + 2 * inverse, PRIMES[which]
    known, base = _powers[at], pow(BASES[which], -1, p) if inverse else BASES[which]
    while len(known) < n:
        step = int(known[-1]) * base % p
        known = np.concatenate([known, known * step % p])
    _powers[at] = known
    return known


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, codes: np.ndarray, head: "Prefixes | None" = None, shared: int = 0):
        """``head``: another text of which the first ``shared`` code points are the same."""
        self.n = len(codes)
        self.h = []
        tail = codes[shared:].astype(np.int64) + 1
        for k, p in enumerate(PRIMES):
            h = np.zeros(self.n + 1, np.int64)
            if shared:
                h[: shared + 1] = head.h[k][: shared + 1]
            terms = tail * powers(k, self.n)[shared : self.n] % p
            h[shared + 1 :] = (h[shared] + np.cumsum(terms)) % p
            self.h.append(h)

    def same(self, i: int, other: "Prefixes", j: int, length: int) -> bool:
        """Whether the spans of ``length`` from ``i`` here and from ``j`` there are equal."""
        for k, p in enumerate(PRIMES):
            w = powers(k, max(i, j) + 1)
            a = (int(self.h[k][i + length]) - int(self.h[k][i])) * int(w[j])
            b = (int(other.h[k][j + length]) - int(other.h[k][j])) * int(w[i])
            if (a - b) % p:
                return False
        return True

    def extension(self, i: int, other: "Prefixes", j: int) -> int:
        """Longest common extension to the right from ``i`` here and ``j`` there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def extension_left(self, i: int, other: "Prefixes", j: int) -> int:
        """Longest common extension to the left, ending before ``i`` here and before ``j`` there."""
        low, high = 0, min(i, j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i - middle, other, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def likeness(self, other: "Prefixes") -> float:
        longest = max(self.n, other.n)
        if not longest:
            return 1.0
        prefix = self.extension(0, other, 0)
        suffix = self.extension_left(self.n, other, other.n)
        return min(prefix + suffix, self.n, other.n) / longest

    def fingerprint(self) -> "Fingerprint":
        at, windows, level = np.zeros(0, np.int64), np.zeros(0, np.int64), BASE_LEVEL
        if self.n > WINDOW:
            h, p = self.h[0], PRIMES[0]
            # A window that ends with the text ends no span, so it is none of these.
            windows = (h[WINDOW:-1] - h[: -WINDOW - 1]) % p * powers(0, self.n, inverse=True)[: self.n - WINDOW] % p
            marks = _marks(windows)
            at = np.flatnonzero(marks & ((1 << level) - 1) == 0)
            while len(at) > CUTS:
                at, level = at[marks[at] & (1 << level) == 0], level + 1
            windows, at = windows[at], at + WINDOW
        ends = np.append(at, self.n)
        return Fingerprint(level, ends, windows, [h[ends] for h in self.h])


def _marks(windows: np.ndarray) -> np.ndarray:
    """Mixed hashes, whose low zero bits choose the cuts."""
    return ((windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)


class Fingerprint:
    """Prefix residues at the cuts of a text (``windows``: the hash that ends at each cut) and at its end."""

    def __init__(self, level: int, ends: np.ndarray, windows: np.ndarray, residues: list[np.ndarray]):
        self.level, self.ends, self.windows, self.residues = level, ends, windows, residues
        self.n = int(ends[-1])
        self._spans: dict[int, tuple] = {}

    def __str__(self) -> str:
        cuts = zip(self.ends.tolist(), [*self.windows.tolist(), 0], *(r.tolist() for r in self.residues))
        return f"{self.level:x}:" + "".join("%08x%08x%08x%08x" % c for c in cuts)

    @classmethod
    def parse(cls, text: str) -> "Fingerprint":
        level, digits = text.split(":")
        numbers = np.array([int(digits[i : i + 8], 16) for i in range(0, len(digits), 8)], dtype=np.int64).reshape(-1, 4)
        return cls(int(level, 16), numbers[:, 0], numbers[:-1, 1], [numbers[:, 2], numbers[:, 3]])

    def spans(self, level: int) -> tuple[list[tuple], list[int], list[list[int]]]:
        """Spans between cuts of ``level`` and up: their keys, their bounds, and the residues there.

        A key is the window before the span (-1 at the start), its length, and its
        residues brought to the text's start.
        """
        if level not in self._spans:
            kept = np.flatnonzero(_marks(self.windows) & ((1 << level) - 1) == 0)
            some = np.append(kept, len(self.windows))
            bounds = np.concatenate([[0], self.ends[some]])
            before = np.concatenate([[-1], self.windows[kept]])
            values = [np.concatenate([[0], r[some]]) for r in self.residues]
            moved = [(v[1:] - v[:-1]) % p * powers(k, self.n + 1, inverse=True)[bounds[:-1]] % p for k, (v, p) in enumerate(zip(values, PRIMES))]
            keys = list(zip(before.tolist(), np.diff(bounds).tolist(), *(m.tolist() for m in moved)))
            self._spans[level] = keys, bounds.tolist(), [v.tolist() for v in values]
        return self._spans[level]


def _same(i: int, j: int, a: tuple, b: tuple, count: int) -> bool:
    """Whether the ``count`` spans from span ``i`` of one text equal those from span ``j`` of the other, taken as one."""
    (_, x, hx), (_, y, hy) = a, b
    if x[i + count] - x[i] != y[j + count] - y[j]:
        return False
    for k, p in enumerate(PRIMES):
        w = powers(k, max(x[i], y[j]) + 1)
        if ((hx[k][i + count] - hx[k][i]) * int(w[y[j]]) - (hy[k][j + count] - hy[k][j]) * int(w[x[i]])) % p:
            return False
    return True


def alike(one: Fingerprint, other: Fingerprint) -> float:
    """Share of the longer text that equal spans cover (1.0 for two empty texts)."""
    longest = max(one.n, other.n)
    if not longest:
        return 1.0
    level = max(one.level, other.level)
    a, b = one.spans(level), other.spans(level)
    places: dict[tuple, list[int]] = {}
    for j in range(len(b[0]) - 1, -1, -1):
        places.setdefault(b[0][j], []).append(j)
    free = [True] * len(b[0])
    i = covered = 0
    while i < len(a[0]):
        waiting = places.get(a[0][i], [])
        while waiting and not free[waiting[-1]]:
            waiting.pop()
        if not waiting:
            i += 1
            continue
        j = waiting[-1]
        most = min(len(a[0]) - i, next((k for k in range(j, len(free)) if not free[k]), len(free)) - j)
        low = 1
        while low < most:
            middle = (low + most + 1) // 2
            if _same(i, j, a, b, middle):
                low = middle
            else:
                most = middle - 1
        if a[0][i : i + low] != b[0][j : j + low]:
            low = 1  # equal texts cut unlike, by windows that begin before them
        covered += a[1][i + low] - a[1][i]
        free[j : j + low] = [False] * low
        i += low
    return covered / longest


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def _key(doc: int | None, body: int) -> tuple:
    return (doc is not None, doc or 0, body)


def _route(heads: list[tuple]):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        repeated: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, body, text in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist(), batch["_bytes"].to_pylist()):
                key, packed = _key(doc, body), pack(text)
                at = max(bisect_right(heads, key) - 1, 0)
                rows = [(at, False)]
                if key == heads[at] and at not in repeated:
                    repeated.add(at)
                    rows.append(((at - 1) % len(heads), True))
                for part, tail in rows:
                    for column, value in zip(out, (part, tail, doc, body, packed)):
                        column.append(value)
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["part", "tail", "doc_id", "body", "packed"])

    return run


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "alike_edited double, alike_next double"
)


def _compare(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
    part, before = None, None

    def row(own, following):
        doc, text, hashes, print_ = own
        other, next_hashes, next_print = following
        new = edited(text, other)
        new_hashes = Prefixes(code_points(new), hashes, len(text) - len(text) // 2)
        new_print = new_hashes.fingerprint()
        return (
            doc, hashes.n, hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), str(print_), str(new_print),
            hashes.likeness(new_hashes), hashes.likeness(next_hashes), alike(print_, new_print), alike(print_, next_print),
        )

    for batch in batches:
        rows = []
        for at, tail, doc, packed in zip(*(batch[c].to_pylist() for c in ("part", "tail", "doc_id", "packed"))):
            if at != part:
                part, before = at, None
            if tail and before is None:
                continue  # one copy of the next partition's first document is enough
            text = unpack(packed).decode("utf-8", "replace")
            hashes = Prefixes(code_points(text))
            print_ = hashes.fingerprint()
            if before is not None:
                rows.append(row(before, (text, hashes, print_)))
            before = None if tail else (doc, text, hashes, print_)
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses (columns of ``RESULT``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("body"), F.encode(text, "UTF-8").alias("_bytes"))
    narrow = staged(marked.select("doc_id", "body"), "order")
    by = [F.col("doc_id").asc_nulls_first(), F.col("body")]
    ranges = narrow.repartitionByRange(shuffle_width(spark), *by)
    firsts = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "body")).alias("head"))
    # One row for each range partition.
    heads = sorted(_key(r["head"]["doc_id"], r["head"]["body"]) for r in firsts.collect())
    drop_staged(narrow)
    if not heads:
        return spark.createDataFrame([], RESULT)
    routed = marked.mapInArrow(worker(_route(heads)), "part int, tail boolean, doc_id long, body long, packed binary")
    placed = routed.repartitionById(len(heads), "part").sortWithinPartitions("part", "tail", *by)
    return placed.mapInArrow(worker(_compare, "powers"), RESULT)


def op10_fingerprints(spark, sf_dir) -> DataFrame:
    """Fingerprints of all documents and their edited texts; likenesses are those of the fingerprints."""
    out = fingerprint_neighbours(table(spark, sf_dir, "documents"))
    alike_ = [F.col("alike_edited").alias("near_edited"), F.col("alike_next").alias("near_next")]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *alike_)
