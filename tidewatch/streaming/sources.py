"""Streaming readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch import schemas


def message_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw feed messages (JSON lines of platform, payload, received_ms) as a stream."""
    return (
        spark.readStream.schema(schemas.RAW_MESSAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def table_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100
) -> DataFrame:
    """New Parquet files of a table as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def kafka_messages(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Raw feed messages from Kafka (needs the Kafka connector on the class path).

    The message key is the platform, the value the payload; arrival time is the record time.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )
    return raw.selectExpr(
        "string(key) as platform", "string(value) as payload",
        "unix_millis(timestamp) as received_ms",
    )
