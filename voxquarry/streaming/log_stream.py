"""Streams of changes into a versioned table (an extension; the format itself has no streams).

Each micro-batch keeps the last change of a key, writes one part and commits one
version.  The batch id goes to the version's metadata, so a batch that is run
again after a failure is recognised and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from voxquarry.operators.log import GONE, VersionedTable
from voxquarry.operators.ordered import latest_wins


def apply_batch(table: VersionedTable, changes: DataFrame, order: list[str], stream: str, batch: int) -> None:
    """Upsert and delete (rows where ``_deleted``) one batch, once."""
    meta = table.meta()
    done = meta.get("streams", {})
    if done.get(stream, -1) >= batch:
        return
    last = latest_wins(changes, table.key, order)
    kept = last.drop(*[c for c in order if c not in table.read().columns])
    if GONE in kept.columns:
        table.upsert(kept.filter(f"NOT {GONE}").drop(GONE))
        table.delete(kept.filter(GONE))
    else:
        table.upsert(kept)
    table.set_meta(meta | {"streams": done | {stream: batch}})
    table.checkpoint()


def start(changes: DataFrame, table: VersionedTable, order: list[str], checkpoint: str, stream: str = "main", **trigger) -> StreamingQuery:
    """Feed a streaming DataFrame of changes to ``table``."""
    writer = changes.writeStream.foreachBatch(lambda df, batch: apply_batch(table, df, order, stream, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def autosave(changes: DataFrame, table: VersionedTable, order: list[str], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """The same on a timer."""
    return start(changes, table, order, checkpoint, processingTime=every)
