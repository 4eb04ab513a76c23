"""A change feed applied to a versioned table, micro-batch by micro-batch.

A micro-batch is the checkpoint barrier: its offset is committed by Spark only
after the table's version is, and the version carries the batch's id, so that a
batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import delete_keys, live_rows
from ..operators.table import VersionedTable


def read_changes(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Change files as a stream; the limit bounds what waits in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_batch(table: VersionedTable, batch: DataFrame, batch_id: int, keys: list[str], columns: list[str], order: str = "pos") -> None:
    batch = batch.persist()
    try:
        if not batch.isEmpty():
            table.commit_delta(delete_keys(batch, keys, order).select(*keys), live_rows(batch, keys, order).select(*columns), keys, batch=batch_id)
    finally:
        batch.unpersist()


def apply_stream(changes: DataFrame, table: VersionedTable, checkpoint: str, keys: list[str], columns: list[str], order: str = "pos") -> StreamingQuery:
    """Apply what is there now and stop; started again it goes on from the checkpoint."""
    return changes.writeStream.foreachBatch(lambda b, i: apply_batch(table, b, i, keys, columns, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def handoff(snapshot: DataFrame, changes: DataFrame, table: VersionedTable, checkpoint: str, keys: list[str], columns: list[str]) -> StreamingQuery:
    """Snapshot first, then the changes from before it on: what the snapshot already has is applied again without harm."""
    if table.current() is None:
        table.overwrite(snapshot.select(*columns), "snapshot")
    return apply_stream(changes, table, checkpoint, keys, columns)


@dataclass
class FlushPolicy:
    """When what has been gathered is written: at a count or size at once, else by age or idleness on a tick."""

    rows: int = 200
    size: int = 128 << 20
    seconds: float = 30
    with_checkpoint: float = 10

    def due(self, rows: int, size: int, oldest: float, idle: float, checkpoint_waits: bool = False) -> bool:
        if rows >= self.rows or size >= self.size:
            return rows > 0
        limit = min(self.seconds, self.with_checkpoint) if checkpoint_waits else self.seconds
        return rows > 0 and (idle >= limit or oldest >= limit)
