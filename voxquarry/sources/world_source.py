"""Spark data source ``voxelworld``: world and structure files as tables.

Options: ``path`` (a file, a folder, or several with commas), ``table`` (one of
:data:`.rows.SCHEMAS`), ``columns_per_task`` for indexed files, ``budget`` (units
a decode may cost), and ``pushdown`` = ``true`` to prune by x and z before any
record is decoded (needs spark.sql.python.filterPushdown.enabled).

A solid file is one task, since its records have no boundaries that could be
found from outside; an indexed file gives a task for each slice of its
directory, and each reads only the header, the directory, the palettes and its
own frames.  ``worlds`` and the palettes never touch a record.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voxquarry.codec.indexed import IndexedFile, Ranged
from voxquarry.codec.limits import DEFAULT_BUDGET
from voxquarry.codec.solid import INDEXED, STRUCTURE, read_header, read_meta_only, read_palette_only, read_structure, read_world

from .rows import META_TABLES, SCHEMAS, column_rows, meta_rows, structure_rows

#: Files whose headers are read at a time when a scan is planned.
OPENERS = 32


def store_of(path: str):
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """Files below each of the comma-separated paths, in order; hidden ones aside."""
    out = []
    for one in path.split(","):
        store, top = store_of(one)
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        if info.type == fs.FileType.File:
            out.append(one)
            continue
        prefix = one.split("://")[0] + "://" if "://" in one else ""
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        out += sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return out


@dataclass
class Slice(InputPartition):
    """A file, or some columns of an indexed one."""

    path: str
    keys: list | None = None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "columns")
        self.path = options["path"]
        self.per_task = int(options.get("columns_per_task", 1024))
        self.budget = int(options.get("budget", DEFAULT_BUDGET))
        self.tests: list = []

    def wants(self, x: int, z: int) -> bool:
        return all(test(x if name in ("x", "chunk_x") else z) for name, test in self.tests)

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(OPENERS) as pool:
            return [part for parts in pool.map(self.slices, listed(self.path)) for part in parts]

    def slices(self, path: str) -> list[InputPartition]:
        """Tasks of one file; of an indexed one, only of the columns that are wanted."""
        if self.table in META_TABLES:
            return [Slice(path)]
        store, at = store_of(path)
        with store.open_input_file(at) as f:
            data = Ranged(f)
            kind, mode, _, _ = read_header(data)
            if mode != INDEXED or kind == STRUCTURE:
                return [Slice(path)]
            keys = [k for k in IndexedFile(data).entries if self.wants(*k)]
        return [Slice(path, keys[i : i + self.per_task]) for i in range(0, len(keys), self.per_task)]

    def read(self, part: Slice) -> Iterator[tuple]:
        store, at = store_of(part.path)
        with store.open_input_file(at) as f:
            if part.keys is not None:
                file = IndexedFile(Ranged(f), self.budget)
                for x, z in part.keys:
                    yield from column_rows(part.path, self.table, file.column(x, z))
                return
            head = Ranged(f)
            kind, mode, _, _ = read_header(head)
            if mode == INDEXED:
                yield from meta_rows(part.path, self.table, IndexedFile(head, self.budget).world([]))
                return
            f.seek(0)  # reads at given places leave the position open
            data = f.read()
        if kind == STRUCTURE:
            yield from structure_rows(part.path, self.table, read_structure(data, self.budget))
            return
        if self.table == "worlds":
            yield from meta_rows(part.path, self.table, read_meta_only(data))
            return
        if self.table == "block_palette":
            w = read_meta_only(data)
            w.states = read_palette_only(data)
            yield from meta_rows(part.path, self.table, w)
            return
        w = read_world(data, self.budget)
        if self.table in META_TABLES:
            yield from meta_rows(part.path, self.table, w)
            return
        for c in w.columns:
            if self.wants(c.x, c.z):
                yield from column_rows(part.path, self.table, c)


class PruningReader(Reader):
    """Takes comparisons of a column's position before decoding."""

    def pushFilters(self, filters: list) -> Iterator:
        names = {"columns": ("x", "z"), "sections": ("x", "z"), "biome_sections": ("x", "z"), "light": ("x", "z"), "entities": ("chunk_x", "chunk_z")}.get(self.table, ())
        tests = {
            EqualTo: lambda v: lambda c: c == v, GreaterThan: lambda v: lambda c: c > v, GreaterThanOrEqual: lambda v: lambda c: c >= v,
            LessThan: lambda v: lambda c: c < v, LessThanOrEqual: lambda v: lambda c: c <= v, In: lambda v: lambda c: c in v,
        }
        for f in filters:
            if type(f) in tests and len(f.attribute) == 1 and f.attribute[0] in names:
                self.tests.append((f.attribute[0], tests[type(f)](f.value)))
            else:
                yield f


class VoxelWorld(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxelworld"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "columns")]

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return PruningReader(options) if options.get("pushdown", "false") == "true" else Reader(options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("voxelworld")`` known."""
    spark.dataSource.register(VoxelWorld)


def tables(spark: SparkSession, path: str, **options) -> dict:
    """Every world table of the files at ``path``, lazily."""
    register(spark)
    made = {}
    for name in SCHEMAS:
        made[name] = spark.read.format("voxelworld").options(path=path, table=name, **options).load()
    return made
