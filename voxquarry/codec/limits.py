"""Ceilings and errors of the world format."""

from __future__ import annotations

# Fixed values of the format.
VERSION = 2
HEADER_MAGIC, FOOTER_MAGIC = b"PILE", b"ELIP"
HEADER_SIZE, FOOTER_SIZE = 16, 44
MAX_BODY = 512 << 20
MAX_WINDOW = 8 << 20
MAX_STRING = 65_535
MAX_NBT_STRING = 32_767
MAX_BLOB = 16 << 20
MAX_NBT_DEPTH = 64
MAX_NBT_CONTAINERS = 1 << 20
MAX_CHUNKS = 1 << 26
MAX_STORAGES = 1 << 22
MAX_PALETTE = 1 << 20
MAX_BLOBS = 1 << 24
MAX_LOCAL = 1 << 16
MAX_PROPERTIES = 64
MAX_SECTIONS = 4096
SECTION_LOW, SECTION_HIGH = -2048, 2047
MAX_LAYERS = 255
MAX_PER_CHUNK = 1 << 20
MAX_CELLS = 1 << 20
MAX_AXIS = 1 << 20
MAX_FRAME = 64 << 20
MAX_DICTIONARY = 1 << 20
MAX_RECOVERY = 256
CELLS = 4096
LIGHT = 2048
COST_COLUMN, COST_STORAGE, COST_ENTRY = 1024, 128, 256
DEFAULT_BUDGET = 5 << 30


class WorldError(Exception):
    """Anything the format layer reports."""


class Corrupt(WorldError):
    """The file breaks a rule of the format."""


class UnsupportedVersion(WorldError):
    pass


class UnsupportedMode(WorldError):
    pass


class UnknownFlags(WorldError):
    pass


class ChecksumMismatch(WorldError):
    pass


class BudgetExceeded(WorldError):
    """The caller's limit was reached; this says nothing about the file."""


class InvalidContent(WorldError):
    """The writer was given what its reader would refuse."""


class Budget:
    """Units a decode may cost; a smaller limit than the ceiling can be set, never a larger one."""

    def __init__(self, most: int = DEFAULT_BUDGET):
        self.most, self.used = min(most, DEFAULT_BUDGET), 0
        self.storages = 0

    def charge(self, n: int, each: int) -> None:
        self.used += n * each
        if each == COST_STORAGE:
            self.storages += n
            if self.storages > MAX_STORAGES:
                raise Corrupt(f"{self.storages} section storages exceed limit {MAX_STORAGES}")
        if self.used > self.most:
            raise BudgetExceeded(f"decode reached {self.used} units, the limit is {self.most}")
