"""The buffer of recent events as a stream: each market's last rows of the trailing day, kept as state.

State is a list per market, cut to the newest rows and to the trailing day of event time. The watermark trails
by that day, so no row of the day comes too late; a timer per market lets rows go that it has left behind, so a
market that falls silent holds nothing after a day.
The buffers of the markets that a micro-batch touches are written to a folder of that batch (a retried
batch replaces itself); readers take each market's newest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch import schemas
from tidewatch.operators.quality import recent_buffer
from tidewatch.sources import files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
_FIELDS = [f for f in schemas.EVENTS.fields if f.name != "market_id"]
_NAMES = [f.name for f in _FIELDS]
_STATE = T.StructType([T.StructField(f.name, f.dataType) for f in _FIELDS])
_OUT = T.StructType([T.StructField("market_id", T.LongType()), *_STATE.fields])


class LastRows(StatefulProcessor):
    """The newest ``per_market`` rows of a market, none older than ``max_age_ms`` behind its newest row or the watermark."""

    def __init__(self, per_market: int, max_age_ms: int):
        self.per_market, self.max_age_ms = per_market, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _STATE)

    def _keep(self, rows: list[tuple], watermark_ms: int) -> list[tuple]:
        """Put the rows that stay into the state, in order, and set the timer for the oldest of them."""
        at, number = _NAMES.index("timestamp"), _NAMES.index("id")
        rows.sort(key=lambda r: (r[at], r[number]))
        oldest = max(watermark_ms, rows[-1][at] - self.max_age_ms if rows else 0)
        rows = [r for r in rows if r[at] >= oldest][-self.per_market:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.rows.put(rows)
            self.handle.registerTimer(rows[0][at] + 1)
        else:
            self.rows.clear()
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for part in rows:
            part = part[_NAMES].astype(object).where(part[_NAMES].notna(), None)
            held += [tuple(r) for r in part.itertuples(index=False)]
        kept = self._keep(held, timerValues.getCurrentWatermarkInMs())
        out = pd.DataFrame(kept, columns=_NAMES)
        out.insert(0, "market_id", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        self._keep(held, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=[f.name for f in _OUT])

    def close(self) -> None:
        pass


def stream_buffers(events: DataFrame, per_market: int, max_age_ms: int = DAY_MS) -> DataFrame:
    """Whole buffers of the markets that a micro-batch touches. Late rows of the day take their place as any other."""
    timed = events.select("market_id", *_NAMES, F.timestamp_millis("timestamp").alias("event_time")).withWatermark(
        "event_time", f"{max_age_ms} milliseconds")
    return timed.groupBy("market_id").transformWithStateInPandas(
        LastRows(per_market, max_age_ms), _OUT, outputMode="Update", timeMode="EventTime")


def start_buffers(
    events: DataFrame, root: str, checkpoint: str, per_market: int, max_age_ms: int = DAY_MS, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the buffers of an event stream under ``root``. State stores need RocksDB, which is set for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={batch}")

    return (
        stream_buffers(events, per_market, max_age_ms)
        .writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_buffers(spark: SparkSession, root: str, now_ms: int, max_age_ms: int = DAY_MS) -> DataFrame:
    """Each market's newest buffer, without what has left the trailing day meanwhile."""
    written = T.StructType([*_OUT.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(written).parquet(root)
    newest = rows.groupBy("market_id").agg(F.max("batch").alias("batch"))
    return recent_buffer(rows.join(newest, ["market_id", "batch"]).select([f.name for f in schemas.EVENTS]), now_ms, max_age_ms)


def fold_buffers(spark: SparkSession, root: str, now_ms: int, max_age_ms: int = DAY_MS) -> None:
    """Put the newest buffers into one folder (of the last batch there) and let the earlier batches go."""
    batches = sorted(int(n.split("=")[1]) for n, s in files.listing(spark, root) if s < 0 and n.startswith("batch="))
    if len(batches) < 2:
        return
    draft = f"{root}/_folded"
    read_buffers(spark, root, now_ms, max_age_ms).write.mode("overwrite").parquet(draft)
    spark.read.schema(_OUT).parquet(draft).write.mode("overwrite").parquet(f"{root}/batch={batches[-1]}")
    for batch in batches[:-1]:
        files.delete(spark, f"{root}/batch={batch}")
    files.delete(spark, draft)
