"""Incremental ingest of record shards: beyond the batch engine, for shards that arrive over time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftline.sources.schemas import RAW_RECORD


def append_records(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Read the shards that are new since the last call and append their rows, partitioned by kind of record, exactly once."""
    stream = spark.readStream.schema(RAW_RECORD).json(source)
    query = stream.writeStream.format("parquet").partitionBy("record").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
