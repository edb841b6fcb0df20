"""Checking files: one row for each, with the rule that refuses it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxquarry.codec.limits import BudgetExceeded, WorldError
from voxquarry.codec.solid import STRUCTURE, content_hash, read_header, read_structure, read_world


def verdict(data: bytes, budget: int | None = None) -> tuple[str, str | None, str | None]:
    """(status, detail, content hash): ``ok``, the error's kind, or ``budget``, which isn't a verdict on the file."""
    more = {} if budget is None else {"budget": budget}
    try:
        kind = read_header(data)[0]
        found = read_structure(data, **more) if kind == STRUCTURE else read_world(data, **more)
        return "ok", None, content_hash(found)
    except BudgetExceeded as e:
        return "budget", str(e), None
    except WorldError as e:
        return type(e).__name__, str(e), None


def violations(spark: SparkSession, path: str, budget: int | None = None) -> DataFrame:
    """(path, status, detail, content_hash) of every file; Spark lists and reads them, a task for each split of the list."""

    def run(batches):
        for batch in batches:
            found = [verdict(data, budget) for data in batch["content"].to_pylist()]
            columns = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array(c, pa.string()) for c in columns)], names=["path", "status", "detail", "content_hash"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, status string, detail string, content_hash string")
