"""Placing the rows of a stream by a saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..bundle import Bundle


def assign_stream(stream: DataFrame, bundle: Bundle, text: str, row_id: str, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each micro-batch of ``stream`` with its labels and names; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        bundle.assign(batch, text, row_id).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
