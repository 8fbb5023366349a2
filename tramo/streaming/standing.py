"""Standing tables that a stream keeps up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tramo.operators.standing import Standing


def keep_up(stream: DataFrame, table: Standing, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Every batch of the stream is merged into the state in folder once, also if it is sent again after a failure."""

    def take(batch: DataFrame, number: int) -> None:
        table.update(batch, folder, number)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
