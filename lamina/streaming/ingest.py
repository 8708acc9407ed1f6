"""Packing as streams arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.archive import Archive


def ingest(streams: DataFrame, archive: Archive, checkpoint: str, **trigger) -> StreamingQuery:
    """Pack each micro-batch of streams (stream_id, data). A batch that runs again after a failure finds its streams packed and passes
    over them."""

    def put(batch: DataFrame, _: int) -> None:
        archive.pack(batch)

    return streams.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_seen(rows: DataFrame, key: str, order: str, store: str, checkpoint: str) -> StreamingQuery:
    """Keep in the table `store`, a folder for each batch, the first row of each key over all batches: those of a batch that earlier batches
    lack. A batch that runs again after a failure doesn't look at what it wrote itself, and writes the same rows to the same place."""
    spark = rows.sparkSession
    schema = rows.select(key, order).schema

    def put(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
        if number:
            before = spark.read.schema(f"{_ddl(schema)}, batch long").parquet(store).where(F.col("batch") < number)
            new = new.join(before.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={number:08d}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
