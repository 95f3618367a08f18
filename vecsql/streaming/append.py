"""Keeping an index up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecsql.operators.index import Catalog


def append_stream(catalog: Catalog, name: str, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch of the stream's rows goes into the index.

    The rows of a batch and its number become visible in one step, so a batch that a restart delivers
    again is either passed over or written over. ``once`` takes what there is and stops.
    """

    def take(batch: DataFrame, number: int) -> None:
        if catalog.get(name).extra.get("last_batch", -1) >= number:
            return
        if batch.take(1):
            catalog.insert(name, batch, last_batch=number)
        else:
            catalog.note(name, last_batch=number)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def delete_stream(catalog: Catalog, name: str, keys: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch of keys is deleted from the index, once: delivered again, it would hide rows that came back since."""

    def take(batch: DataFrame, number: int) -> None:
        if catalog.get(name).extra.get("last_deletes", -1) < number:
            catalog.delete(name, batch, last_deletes=number)

    writer = keys.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
