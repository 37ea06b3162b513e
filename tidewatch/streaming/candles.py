"""One-minute candles from the event stream.

``start_bars`` writes what each micro-batch adds to its minutes; a late row of any market adds to its minute as
any other row, so its bar changes without a watermark, a state or a repair. ``stream_candles`` gives each bar
once, when the watermark has passed it, for sinks that can only append.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.candles import MINUTE_MS, bars_of_partials, joined_bars, minute_bar_columns, minute_candles, partial_bars
from tidewatch.sources import manifest
from tidewatch.sources.store import event_day


def stream_candles(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Bars of minutes the watermark has passed; rows later than ``delay`` miss their bars here.

    Append mode: every bar comes out once. Aggregates are the ones of the batch operator. The log
    has the late rows; ``repaired_candles`` brings them into the bars as a batch job.
    """
    timed = (
        events.filter(F.col("event_type").isin("price_change", "trade"))
        .withColumn("event_time", F.timestamp_millis("timestamp"))
        .withWatermark("event_time", delay)
    )
    bars = timed.groupBy("market_id", F.window("event_time", "1 minute").alias("w")).agg(
        *minute_bar_columns()
    )
    open_ts = F.unix_millis("w.start")
    return bars.filter(F.col("open").isNotNull()).select(
        "market_id",
        F.lit("1m").alias("interval"),
        open_ts.alias("open_ts"),
        (open_ts + MINUTE_MS).alias("close_ts"),
        "open", "high", "low", "close", "volume", "trade_count",
        (open_ts + MINUTE_MS).alias("created_at"),
    )


def append_batch(bars: DataFrame, batch_id: int, candles_root: str) -> None:
    """foreachBatch sink: each micro-batch has its own folder, so a retry replaces itself.

    In append mode a bar is emitted once, so nothing has to be merged here.
    """
    bars.write.mode("overwrite").parquet(f"{candles_root}/ingest_batch={batch_id}")


def repaired_candles(
    stored: DataFrame, events: DataFrame, arrived: DataFrame, now_ms: int
) -> DataFrame:
    """Stored bars, with those of every minute touched by ``arrived`` computed anew.

    ``events`` is the whole log and ``arrived`` the rows of it that came since the last repair (or
    all of them). A bar made from the whole log takes the place of the stored one: merging would keep
    an open that an earlier late row has to change. Only bars the stream has passed are touched, so
    ``now_ms`` must not be ahead of its watermark: the stream writes later bars itself.
    """
    key = ["market_id", "open_ts"]
    open_ts = (F.floor(F.col("timestamp") / F.lit(MINUTE_MS)) * MINUTE_MS).cast("long")
    touched = (
        arrived.filter(F.col("event_type").isin("price_change", "trade"))
        .select("market_id", open_ts.alias("open_ts"))
        .distinct()
    )
    again = minute_candles(
        events.withColumn("open_ts", open_ts).join(touched, key, "left_semi").drop("open_ts"), now_ms
    )
    ours = F.lit("1m").alias("interval")
    kept = stored.join(again.select(*key, ours), [*key, "interval"], "left_anti")
    return kept.select(stored.columns).unionByName(again.select(stored.columns))


_POINT = "struct<at:long,id:long,price:double>"
_PARTIAL = f"market_id long, open_ts long, first {_POINT}, last {_POINT}, high double, low double, volume long, trade_count long, event_date date"


def bars_batch(events: DataFrame, batch_id: int, root: str) -> None:
    """What a micro-batch adds to its minutes, in a folder of its own, so a retry replaces itself."""
    _write(partial_bars(events), f"{root}/ingest_batch={batch_id}")


def _write(partials: DataFrame, path: str) -> None:
    dated = partials.withColumn("event_date", event_day(F.col("open_ts")))
    dated.repartition("event_date").sortWithinPartitions("event_date", "market_id", "open_ts").write.mode("overwrite").partitionBy(
        "event_date").parquet(path)


def _read(spark: SparkSession, root: str, folders: Iterable[manifest.Folder]) -> DataFrame:
    paths = [f"{root}/{f.path}" for f in folders]
    return spark.read.schema(_PARTIAL).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], _PARTIAL)


def start_bars(events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(lambda df, b: bars_batch(df, b, root))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_bars(spark: SparkSession, root: str, now_ms: int, since_ms: int | None = None) -> DataFrame:
    """Completed bars as of all rows that have come, of the days from ``since_ms`` on."""
    first = None if since_ms is None else manifest.day_of(since_ms)
    rows = _read(spark, root, [f for f in manifest.current(spark, root).folders if first is None or f.day >= first])
    if since_ms is not None:
        rows = rows.filter(F.col("open_ts") >= since_ms)
    return bars_of_partials(rows.drop("event_date"), now_ms)


def fold_bars(spark: SparkSession, root: str) -> manifest.Manifest:
    """Put the parts of each day together where a day has several; the log's manifest tells which folders count."""
    old = manifest.folded(spark, root)
    by_day: dict[str, list[manifest.Folder]] = {}
    for folder in old.folders:
        by_day.setdefault(folder.day, []).append(folder)
    several = [f for folders in by_day.values() if len(folders) > 1 for f in folders]
    if not several:
        return old
    name = f"ingest_batch=folded-{old.version + 1}"
    _write(joined_bars(_read(spark, root, several)), f"{root}/{name}")
    kept = [f for f in old.folders if f not in several]
    return manifest.publish(spark, root, old, kept + manifest.measured(spark, root, name), old.floor_ms, old.cut_ms)
