"""Incremental profiles of a stream: a mergeable state of each micro-batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import sketch


def start(stream: DataFrame, table: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes the states of its columns under its own number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        sketch.states(batch, table).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile(spark: SparkSession, path: str) -> DataFrame:
    """The approximate profile of all batches so far."""
    return sketch.finished(sketch.merged(spark.read.parquet(path).drop("batch")))
