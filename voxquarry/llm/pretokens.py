"""Cutting texts into chunks that byte-level tokenizers encode independently.

A chunk is a run of white space with the run of other characters behind it.  The
public byte-level pattern never matches across the start of such a chunk, and
what it matches inside depends on nothing outside, so ids of a text are the ids
of its chunks in order.  Chunks repeat far more often than texts, which makes
them worth remembering.
"""

from __future__ import annotations

import re

import regex

#: White space beyond ASCII, and the four separators that only some libraries count.
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SPACE_RUN = re.compile(" [ \t\n\x0b\x0c\r]")
CHUNK = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
#: Characters on which every library's Unicode tables agree: ASCII and Latin letters, no controls.
PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-įı-ž]*")
#: Longest chunk to remember.
LONGEST = 64
#: Bytes that an entry takes besides its letters and ids: two objects and a place in a dict.
ENTRY = 190


def chunks(text: str) -> list[str]:
    """``text`` in chunks; joined, they are the text again."""
    if "\0" not in text and not SPACE_RUN.search(text) and (text.isascii() and not RARE_SPACE.search(text) or not RARE_SPACE.search(text)):
        # No space is followed by white space: each space starts a chunk.
        return text.replace(" ", "\0 ").split("\0")
    return CHUNK.findall(text)


class Memory(dict):
    """Ids by chunk, as little-endian unsigned 32-bit integers; bounded in bytes.

    A full memory becomes the elder one and a new one starts, into which what is
    still in use is taken over: both together hold at most ``most`` bytes, counting
    ``ENTRY`` for the objects of an entry besides its letters and ids.
    """

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.half = encode, most // 2
        self.elder: dict[str, bytes] = {}
        self.held = 0
        self[""] = b""

    def find(self, chunk: str) -> bytes | None:
        """What is remembered of a chunk, or None."""
        ids = self.get(chunk)
        if ids is None:
            ids = self.elder.get(chunk)
            if ids is not None:
                self.keep(chunk, ids)
        return ids

    def keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONGEST:
            if self.held >= self.half:
                self.elder = dict(self)
                self.clear()
                self.held = 0
                self[""] = b""
            self[chunk] = ids
            self.held += ENTRY + len(chunk) + len(ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.elder.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self.keep(chunk, ids)
        return ids
