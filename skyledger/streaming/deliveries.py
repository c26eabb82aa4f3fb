"""Deliveries as a stream of files, laid over a source table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_deliveries(spark: SparkSession, folder: str, schema: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``apply`` with each batch of newly landed parquet files, once per batch id even after a restart."""
    lines = spark.readStream.schema(schema).parquet(folder)
    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
