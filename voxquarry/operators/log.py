"""A versioned table: append, delete, checkpoint, compact, snapshot, roll back, branch.

Data lives in Parquet parts below a folder.  A commit is one JSON file that lists
the parts of a version; it is written beside, after its parts, and then given its
name if no other writer took that, so a reader sees a version whole or not at
all, a crash leaves the one before, and of two writers the later goes on from
the other's version.  Parts are never changed, which makes old versions,
snapshots and branches views of the same files.

Changes carry a sequence number; the last change of a key wins, deletions
included.  Reading resolves them by aggregation and one anti-join.  Many parts of
changes are folded into one, so plans don't grow with the number of checkpoints.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxquarry.codec.limits import InvalidContent
from voxquarry.operators.ordered import latest_wins
from voxquarry.sources.world_source import store_of

SEQUENCE, GONE = "_sequence", "_deleted"
GARBAGE_LIMIT = 0.5
#: Parts of changes from which on a checkpoint folds them into one.
FOLD = 32


class VersionedTable:
    """One table of worlds, or any table with a key."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], read_only: bool = False, branch: str = "main"):
        self.spark, self.path, self.key, self.read_only, self.branch = spark, path.rstrip("/"), key, read_only, branch
        self.store, self.top = store_of(self.path)
        self.pending: list[dict] = []
        self.meta_pending: dict | None = None

    # ---- commits

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: list[str], df: DataFrame) -> "VersionedTable":
        """A table whose first version is ``df``."""
        t = cls(spark, path, key)
        if t.versions():
            raise InvalidContent(f"{path} holds a table")
        base = t._write(df, "base")
        first = {"base": base, "changes": [], "rows": df.count(), "schema": df.schema.json(), "meta": {}}

        def only(newest: dict | None) -> dict:
            if newest is not None:
                raise InvalidContent(f"{path} holds a table")
            return first

        t._commit(only)
        return t

    def _folder(self) -> str:
        return f"{self.top}/_log/{self.branch}"

    def versions(self) -> list[int]:
        info = self.store.get_file_info(self._folder())
        if info.type == fs.FileType.NotFound:
            return []
        names = [f.base_name for f in self.store.get_file_info(fs.FileSelector(self._folder()))]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def _load(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise InvalidContent(f"{self.path} holds no version of {self.branch}")
        version = known[-1] if version is None else version
        with self.store.open_input_stream(f"{self._folder()}/{version:012d}.json", compression=None) as f:
            return json.loads(f.read()) | {"version": version}

    def _commit(self, change: Callable[[dict | None], dict]) -> int:
        """Make ``change`` of the newest state the next version; if another writer gets there first, of theirs."""
        self.store.create_dir(self._folder(), recursive=True)
        while True:
            known = self.versions()
            version = (known or [0])[-1] + 1
            state = change(self._load(known[-1]) if known else None)
            name = f"{version:012d}.json"
            beside = f"{name}.{uuid.uuid4().hex}"
            with self.store.open_output_stream(f"{self._folder()}/{beside}", compression=None) as f:
                f.write(json.dumps({k: v for k, v in state.items() if k != "version"}).encode())
            claim = self._linked if isinstance(self.store, fs.LocalFileSystem) else self._renamed
            if claim(beside, name):
                return version

    def _linked(self, beside: str, name: str) -> bool:
        """Name a local file unless the name is taken."""
        try:
            os.link(f"{self._folder()}/{beside}", f"{self._folder()}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{self._folder()}/{beside}")

    def _renamed(self, beside: str, name: str) -> bool:
        """The same by a Hadoop rename that doesn't overwrite: atomic on HDFS, not on every object store."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.path}/_log/{self.branch}")
        context = hadoop.FileContext.getFileContext(top.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(hadoop.Path(top, beside), hadoop.Path(top, name), plain)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            context.delete(hadoop.Path(top, beside), False)
            return False

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _writable(self) -> None:
        if self.read_only:
            raise InvalidContent("the table is read-only")

    # ---- changes

    def upsert(self, df: DataFrame) -> None:
        """Stage rows; of rows with one key the last staged wins."""
        self._writable()
        self.pending.append({"part": self._write(df.withColumn(GONE, F.lit(False)), "change")})

    def delete(self, keys: DataFrame) -> None:
        self._writable()
        gone = keys.select(*self.key).distinct()
        self.pending.append({"part": self._write(gone.withColumn(GONE, F.lit(True)), "change")})

    def set_meta(self, meta: dict) -> None:
        self._writable()
        self.meta_pending = meta

    def checkpoint(self) -> int | None:
        """Make what is staged the newest version; nothing staged, nothing written.

        What another writer committed meanwhile lies below it; staged metadata replaces theirs.
        """
        self._writable()
        if not self.pending and self.meta_pending is None:
            return None
        staged = [c["part"] for c in self.pending]

        def changed(newest: dict | None) -> dict:
            changes = newest["changes"] + staged
            if len(changes) > FOLD:
                changes = [self._folded(changes, newest)]
            return newest | {"changes": changes} | ({} if self.meta_pending is None else {"meta": self.meta_pending})

        version = self._commit(changed)
        self.pending, self.meta_pending = [], None
        return version

    def _folded(self, parts: list[str], state: dict) -> str:
        """One part that does what these do, one after the other."""
        changes = self._changes(parts, StructType.fromJson(json.loads(state["schema"])))
        return self._write(latest_wins(changes, self.key, [SEQUENCE]).drop(SEQUENCE), "change")

    # ---- reading

    def _changes(self, parts: list[str], schema) -> DataFrame | None:
        out = None
        for i, part in enumerate(parts):
            df = self.spark.read.parquet(f"{self.path}/{part}")
            for field in schema.fields:
                if field.name not in df.columns:
                    df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
            df = df.select(*[f.name for f in schema.fields], GONE, F.lit(i).alias(SEQUENCE))
            out = df if out is None else out.unionByName(df)
        return out

    def _resolved(self, state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        base = self.spark.read.schema(schema).parquet(f"{self.path}/{state['base']}")
        changes = self._changes(state["changes"], schema)
        if changes is None:
            return base
        last = latest_wins(changes, self.key, [SEQUENCE])
        return base.join(last.select(*self.key), self.key, "left_anti").unionByName(last.filter(f"NOT {GONE}").select(*base.columns))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version; the newest by default.  Staged changes don't show."""
        return self._resolved(self._load(version))

    def meta(self, version: int | None = None) -> dict:
        return self._load(version)["meta"]

    def garbage_ratio(self) -> float:
        """Share of stored rows that the newest version doesn't show."""
        state = self._load()
        parts = [state["base"], *state["changes"]]
        stored = self.spark.read.schema(StructType([])).parquet(*[f"{self.path}/{part}" for part in parts]).count()
        return 1 - self.read().count() / stored if stored else 0.0

    # ---- maintenance

    def compact(self, cluster=None) -> int:
        """Rewrite what is live as the base of a new version; ``cluster`` orders it (see zorder.cluster)."""
        self._writable()
        state = self._load()
        live = self._resolved(state)
        base = self._write(cluster(live) if cluster else live, "base")
        done = state["changes"]

        def compacted(newest: dict | None) -> dict:
            if newest["base"] != state["base"] or newest["changes"][: len(done)] != done:
                raise InvalidContent("the table was rewritten meanwhile")
            return newest | {"base": base, "changes": newest["changes"][len(done) :]}

        return self._commit(compacted)

    def close(self) -> None:
        """Checkpoint, and compact where more than half is garbage."""
        if not self.read_only:
            self.checkpoint()
            if self.garbage_ratio() > GARBAGE_LIMIT:
                self.compact()

    # ---- snapshots and branches

    def _named(self, name: str) -> str:
        if not name or name in (".", "..") or "/" in name or "\\" in name:
            raise InvalidContent(f"{name!r} is not a snapshot's name")
        return f"{self.top}/_log/snapshots/{name}.json"

    def snapshot(self, name: str) -> None:
        """Name the newest version; its metadata belongs to it."""
        state = self._load()
        at = self._named(name)
        self.store.create_dir(f"{self.top}/_log/snapshots", recursive=True)
        with self.store.open_output_stream(at, compression=None) as f:
            f.write(json.dumps(state).encode())

    def snapshots(self) -> list[str]:
        info = self.store.get_file_info(f"{self.top}/_log/snapshots")
        if info.type == fs.FileType.NotFound:
            return []
        return sorted(f.base_name[:-5] for f in self.store.get_file_info(fs.FileSelector(f"{self.top}/_log/snapshots")))

    def rollback(self, name: str) -> int:
        """Commit a snapshot's content and metadata as the newest version; staged changes are dropped."""
        self._writable()
        with self.store.open_input_stream(self._named(name), compression=None) as f:
            state = json.loads(f.read())
        self.pending, self.meta_pending = [], None
        return self._commit(lambda _: state)

    def delete_snapshot(self, name: str) -> None:
        self._writable()
        self.store.delete_file(self._named(name))

    def fork(self, branch: str) -> "VersionedTable":
        """A branch over the same parts; neither sees the other's later commits."""
        self._named(branch)
        out = VersionedTable(self.spark, self.path, self.key, False, branch)
        if out.versions():
            raise InvalidContent(f"branch {branch} exists")
        state = self._load()
        out._commit(lambda _: state)
        return out
