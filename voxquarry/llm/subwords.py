"""The tokenizers library's encodings, remembered by chunk.

Each chunk of text (see :mod:`.pretokens`) is encoded once per worker and kept.
Chunks of plain Latin text are split by the vocabulary's own pattern and handed
to the library's BPE model directly; any other chunk goes through the library's
whole chain, normaliser included.  Both give the ids of the library's
``encode(text, add_special_tokens=False)`` with special tokens' strings taken as
ordinary text.
"""

from __future__ import annotations

import os
import struct

import regex

from .common import CACHES
from .pretokens import PLAIN, Memory, chunks

#: Bytes of chunks and their pieces remembered by a worker.
REMEMBERED = 72 << 20

_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of the word vocabulary's normaliser and pattern.
_SPACES = regex.compile(r"\p{White_Space}+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Subwords:
    """A byte-level vocabulary file of the tokenizers library (``words``: one that drops white space and case)."""

    def __init__(self, path: str, words: bool, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.words = words
        self.find = regex.compile(_WORD_PATTERN if words else _BYTE_PATTERN).findall
        self.known = Memory(self._chunk, remembered)
        self.tokenize = self.model.tokenize

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", _LETTERS[32])  # the only one of these that another letter stands for
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return pack([t.id for t in self.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; one that is a single piece, as most are, is remembered once."""
        if PLAIN.fullmatch(chunk):
            pieces = self.find(chunk.lower() if self.words else chunk)
            if len(pieces) == 1 and pieces[0] == chunk:
                return self._piece(chunk)
            return b"".join(map(self.known.__getitem__, pieces))
        return pack(self.library.encode(chunk, add_special_tokens=False).ids)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.words:
            parts = chunks(text)
        elif any(c in text for c in "\x1c\x1d\x1e\x1f"):
            parts = _SPACES.split(text)  # str.split() would count these as spaces
        else:
            parts = text.split()
        return b"".join(map(self.known.__getitem__, parts))


_made: dict[tuple[str, bool], Subwords] = {}
CACHES["subwords"] = _made.clear


def subwords(name: str, words: bool, path: str | None = None, remembered: int = REMEMBERED) -> Subwords:
    """This worker's encoder for a vocabulary file, made once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    if (path, words) not in _made:
        _made[path, words] = Subwords(path, words, remembered)
    return _made[path, words]
