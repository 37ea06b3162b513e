"""Alerts for anomalies as they are stored: each anomaly once, each user at most so often."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas
from tidewatch.operators import alerts as a
from tidewatch.sources import files


REMEMBERED = "24 hours"  # of detection time: as long as an anomaly lives


def unseen(feed: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """Drop anomalies already delivered by the stream.

    State holds the ids of the trailing time only; what comes again later than that is too late for the
    watermark and dropped as well.
    """
    timed = feed.filter("anomaly_id is not null").withColumn("__at", F.timestamp_millis("detected_at"))
    return timed.withWatermark("__at", remembered).dropDuplicatesWithinWatermark(["anomaly_id"]).drop("__at")


_STORED = T.StructType([*schemas.ALERTS.fields, T.StructField("hour", T.LongType()), T.StructField("batch", T.LongType())])


def sent_lately(spark: SparkSession, alerts_root: str, batch_id: int, now_ms: int) -> DataFrame:
    """Alerts of earlier batches from the folders of this hour and the one before: no other can hold any of the last hour."""
    hour = now_ms // a.HOUR_MS
    paths = [f"{alerts_root}/hour={h}" for h in (hour - 1, hour) if files.listing(spark, f"{alerts_root}/hour={h}")]
    rows = spark.read.schema(_STORED).option("basePath", alerts_root).parquet(*paths) if paths else spark.createDataFrame([], _STORED)
    return rows.filter(F.col("batch") < batch_id).drop("hour", "batch")


def alert_batch(feed: DataFrame, batch_id: int, users: DataFrame, alerts_root: str, now_ms: int) -> None:
    """Create the alerts of one micro-batch under the folder of its hour and number, so a retry replaces itself."""
    spark = feed.sparkSession
    sent = sent_lately(spark, alerts_root, batch_id, now_ms)
    matched = a.matched_and_throttled(a.labelled(feed), a.alertable_users(users), sent, now_ms)
    # an attempt that broke off in an earlier hour left its folder in the newest one
    hours = sorted((int(n[5:]) for n, size in files.listing(spark, alerts_root) if size < 0 and n.startswith("hour=")), reverse=True)
    for hour in hours[:1]:
        files.delete(spark, f"{alerts_root}/hour={hour}/batch={batch_id}")
    a.create_alerts(matched, now_ms).write.mode("overwrite").parquet(f"{alerts_root}/hour={now_ms // a.HOUR_MS}/batch={batch_id}")


def start_alerts(
    feed: DataFrame, users: DataFrame, alerts_root: str, checkpoint: str, clock, trigger: dict | None = None
) -> StreamingQuery:
    """``clock()`` gives the current epoch ms when a micro-batch starts."""
    return (
        unseen(feed)
        .writeStream.foreachBatch(lambda df, b: alert_batch(df, b, users, alerts_root, clock()))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
