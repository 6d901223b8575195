"""Beyond batch: observations that arrive as a stream, appended to a table and resolved anew for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.fuse import fuse
from tessera.operators.resolve import resolve


def ingest(observations: DataFrame, table_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Append each batch of a stream of observations to parquet at ``table_path``, one folder a batch, and hand the
    canonical records of all that arrived so far to ``sink``.

    A batch that is tried again overwrites its own folder, so nothing counts twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        every = batch.sparkSession.read.parquet(table_path).drop("batch")
        record_cluster, _, _ = resolve(every)
        sink(fuse(every, record_cluster), number)

    writer = observations.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
