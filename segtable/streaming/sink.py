"""A stream into a managed table, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.writing import insert
from ..sources.table import ManagedTable


def write_stream(table: ManagedTable, stream: DataFrame, checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """Start appending ``stream``; the commit of a batch holds its number, so a batch that runs again adds nothing."""
    sink = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    sink = sink.trigger(**trigger) if trigger else sink

    def append(rows: DataFrame, batch: int) -> None:
        insert(table, rows, (name, batch))

    return sink.foreachBatch(append).start()
