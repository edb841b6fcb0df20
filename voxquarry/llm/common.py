"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker: very long texts then cannot pile up.
BATCH_BYTES = 4 * 1024 * 1024

_own_folder: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark only (the path may be in any store it knows)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes, not only the rows, of each Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What a worker process remembers from task to task: by name, a function that forgets it.
CACHES: dict[str, Callable[[], None]] = {}


def _settle(keeps: str | None) -> None:
    """Forget what another kind of task left in this process; Arrow takes its memory from malloc."""
    for name, forget in CACHES.items():
        if name != keeps:
            forget()
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def _give_back() -> None:
    """Return freed memory to the operating system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def worker(run: Callable, keeps: str | None = None) -> Callable:
    """``run`` for ``mapInArrow``, in a process that serves other tasks before and after.

    Only the cache named ``keeps`` lives on from a task to the next of its kind, so
    the stages of a session don't pile up memory in workers that Spark reuses.
    """

    def wrapped(batches):
        _settle(keeps)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder of its own
    and a cluster is refused, since a machine-local folder is not shared there.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_folder:
        _own_folder[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="voxquarry-")
    return _own_folder[sc.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered for :func:`release`."""
    path = f"{shared_folder(spark)}/vq-{name}-{uuid.uuid4().hex[:12]}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, and runs what is
    above it once even where several later jobs read the result.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vq_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by :func:`staged` that no later result reads."""
    path = getattr(df, "_vq_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def staged_so_far(spark: SparkSession) -> int:
    """How many tables this session has staged: a mark for :func:`release`."""
    return len(_staged.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete what this session staged after the mark ``since``, other than ``but``.

    Results that read it are void afterwards.
    """
    paths = _staged.get(spark.sparkContext.applicationId, [])
    kept = getattr(but, "_vq_path", None)
    for path in paths[since:]:
        if path != kept:
            delete(spark, path)
    paths[since:] = [kept] if kept in paths[since:] else []


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def signed64(value: int) -> int:
    """An unsigned 64-bit integer as Spark's signed long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called ``_c0``, ``_c1``, ...: whatever they were called, none can clash."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str):
    """The column that :func:`numbered` made of ``name`` (exact case; the first of equal names)."""
    return F.col(f"_c{df.columns.index(name)}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, ids as bigint, however other columns are called."""
    chosen = [at(df, n).cast("bigint").alias(n) if n.endswith("_id") else at(df, n).alias(n) for n in names]
    return numbered(df).select(*chosen)
