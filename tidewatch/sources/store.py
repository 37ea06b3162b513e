"""Reading and writing the event log and versioned table snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch import schemas
from tidewatch.functions import fixed_values as fv
from tidewatch.functions.keyed import hashed_id
from tidewatch.session import settle
from tidewatch.sources import files
from tidewatch.sources.manifest import Folder, current, day_of
from tidewatch.sources.messages import ARRIVAL

BATCH_BITS = 34  # rows of a batch; a batch a second fills the rest of a 64-bit id in 17 years


def event_day(ts_ms: Column) -> Column:
    """UTC date of an epoch-ms column, the partition key of the event log."""
    return F.date_from_unix_date(F.floor(ts_ms / F.lit(86_400_000)).cast("int"))


def storable_events(events: DataFrame, persist_price_change: bool = False) -> DataFrame:
    """The event types kept in the log; price changes only on request."""
    kept = schemas.EVENT_TYPES if persist_price_change else fv.PERSISTED_EVENT_TYPES
    return events.filter(F.col("event_type").isin(*kept))


def by_day(df: DataFrame, *folders: str) -> DataFrame:
    """Lay rows out for a partitioned write: few files per folder, a busy folder split evenly.

    Rebalancing is adaptive, so a day with a third of all rows is written by many tasks. Sorted
    files let readers skip row groups by market and time.
    """
    rebalanced = df.hint("rebalance", *[F.col(c) for c in folders])
    return rebalanced.sortWithinPartitions(*folders, "market_id", "timestamp")


def with_arrival_ids(events: DataFrame, batch: int) -> DataFrame:
    """Running ids in order of arrival: the batch in the upper bits, then 0, 1, 2, ... without a gap.

    The order is that of the messages' numbers (``messages.with_arrival``), which a join cannot change; rows
    without such numbers count in the order in which they come. Rows are numbered inside the partitions
    of their source; only the number of rows of each is put in order to give them their first numbers.
    """
    numbered = all(c in events.columns for c in ARRIVAL)
    at = "arrival" if numbered else "__at"
    order = ARRIVAL if numbered else ["__at"]
    rows = settle(events if numbered else events.withColumn("__at", F.monotonically_increasing_id()))
    place = rows.withColumn("__part", F.shiftright(at, 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = place.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    # a partition of the source is bounded, so this window is
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    number = F.col("__start") + F.col("__within")
    full = F.raise_error(F.lit(f"batch {batch} has more than {1 << BATCH_BITS} rows"))
    checked = F.when(number < (1 << BATCH_BITS), number).otherwise(full.cast("long"))
    out = place.withColumn("__within", within).join(starts, "__part").withColumn("id", checked + (batch << BATCH_BITS))
    return out.select("id", *[c for c in events.columns if c != "id" and not (numbered and c in ARRIVAL)])


def append_events(
    events: DataFrame, root: str, batch: int, persist_price_change: bool = True
) -> None:
    """Write one batch under its own folder, so a retried batch replaces itself.

    Rows without ids get running ones in order of arrival. A key made of the content is stored
    beside it, by which re-delivered rows are recognized.
    """
    df = storable_events(events, persist_price_change)
    if "id" not in events.columns:
        df = with_arrival_ids(df, batch)
    df = schemas.conform(df, schemas.EVENTS)
    content = [F.col(c) for c in ("market_id", "event_type", "timestamp", "new_value")]
    df = df.withColumn("content_key", hashed_id(*content, F.coalesce("metadata", F.lit(""))))
    (
        by_day(df.withColumn("event_date", event_day(F.col("timestamp"))), "event_date")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(f"{root}/ingest_batch={batch}")
    )


_LOG = T.StructType(
    [*schemas.EVENTS.fields, T.StructField("content_key", T.LongType()), T.StructField("event_date", T.DateType()),
     T.StructField("ingest_batch", T.StringType())]
)


def read_folders(
    spark: SparkSession, root: str, folders: Iterable[Folder], floor_ms: int | None = None, with_batch: bool = False
) -> DataFrame:
    """The rows of some folders of the log, with all their columns, from a time on."""
    paths = [f"{root}/{f.path}" for f in folders]
    df = spark.read.schema(_LOG).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], _LOG)
    df = df if floor_ms is None else df.filter(F.col("timestamp") >= floor_ms)
    return df if with_batch else df.drop("ingest_batch")


def read_events(
    spark: SparkSession, root: str, since_ms: int | None = None, until_ms: int | None = None,
    with_date: bool = False,
) -> DataFrame:
    """The event log, pruned to the days and row groups of [since_ms, until_ms].

    The folders are those of the newest manifest and the complete batches behind it. ``with_date`` keeps
    event_date, by which ``quality.since`` skips the folders of earlier days.
    """
    log = current(spark, root)
    first, last = (None if ms is None else day_of(ms) for ms in (since_ms, until_ms))
    folders = [f for f in log.folders if (first is None or f.day >= first) and (last is None or f.day <= last)]
    df = read_folders(spark, root, folders, log.floor_ms).drop("content_key")
    if since_ms is not None:
        df = df.filter((F.col("timestamp") >= since_ms) & (F.col("event_date") >= event_day(F.lit(since_ms))))
    if until_ms is not None:
        df = df.filter((F.col("timestamp") <= until_ms) & (F.col("event_date") <= event_day(F.lit(until_ms))))
    return df if with_date else df.drop("event_date")


def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Publish ``df`` as one version of a table; earlier versions stay readable meanwhile."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Newest complete version (from the names in the folder, no job), or None before the first one."""
    named = [int(m.group(1)) for name, _ in files.listing(spark, root) if (m := re.fullmatch(r"version=(\d+)", name))]
    for version in sorted(named, reverse=True):
        if any(name == "_SUCCESS" for name, _ in files.listing(spark, f"{root}/version={version}")):
            return version
    return None


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    wanted = latest_version(spark, root) if version is None else version
    return None if wanted is None else spark.read.parquet(f"{root}/version={wanted}")


def write_markets(markets: DataFrame, root: str, version: int) -> None:
    """Publish the market table; an unknown platform fails the write."""
    rows = schemas.conform(markets, schemas.MARKETS)
    write_snapshot(
        rows.withColumn("platform", schemas.checked("platform", schemas.PLATFORMS)), root, version
    )


def write_anomalies(anomalies: DataFrame, links: DataFrame, root: str, version: int) -> None:
    """Publish the anomaly tables; a type or status outside the enums fails the write."""
    rows = schemas.conform(anomalies, schemas.ANOMALIES).withColumns(
        {
            "anomaly_type": schemas.checked("anomaly_type", schemas.ANOMALY_TYPES),
            "status": schemas.checked("status", schemas.ANOMALY_STATUSES),
        }
    )
    write_snapshot(schemas.conform(links, schemas.ANOMALY_MARKETS), f"{root}/anomaly_markets", version)
    write_snapshot(rows, f"{root}/anomalies", version)


def archive_events(events: DataFrame, root: str, fmt: str = "json") -> None:
    """Hourly archive of the log: one folder per UTC date and hour."""
    hour = F.pmod(F.floor(F.col("timestamp") / F.lit(3_600_000)), F.lit(24)).cast("int")
    (
        by_day(
            events.withColumns({"date": event_day(F.col("timestamp")), "hour": hour}), "date", "hour"
        )
        .write.mode("overwrite")
        .partitionBy("date", "hour")
        .format(fmt)
        .save(root)
    )


def write_csv(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(root)


def rekeyed_copy(source: dict[str, DataFrame], target_markets: DataFrame) -> dict[str, DataFrame]:
    """Rows of another store with market and cluster ids of this one.

    Markets are matched on (platform, external_id); unmatched ones get the id an upsert would
    give them. Events, clusters and memberships follow the same mapping.
    """
    natural = ["platform", "external_id"]
    ours = target_markets.select(*natural, F.col("id").alias("__ours"))
    mapped = source["markets"].join(ours, natural, "left").withColumn(
        "__new", F.coalesce("__ours", hashed_id("market", *[F.col(c) for c in natural]))
    )
    markets = mapped.withColumn("id", F.col("__new")).drop("__ours", "__new")
    ids = mapped.select(F.col("id").alias("market_id"), F.col("__new").alias("__market"))
    clusters = source["clusters"].withColumn("__new", hashed_id("cluster", F.col("name")))
    cluster_ids = clusters.select(F.col("id").alias("cluster_id"), F.col("__new").alias("__cluster"))
    events = source["events"].join(ids, "market_id", "inner").withColumn("market_id", F.col("__market"))
    members = (
        source["memberships"]
        .join(ids, "market_id", "inner")
        .join(cluster_ids, "cluster_id", "inner")
        .withColumn("market_id", F.col("__market"))
        .withColumn("cluster_id", F.col("__cluster"))
    )
    return {
        "markets": markets,
        "events": events.drop("__market"),
        "clusters": clusters.withColumn("id", F.col("__new")).drop("__new"),
        "memberships": members.drop("__market", "__cluster"),
    }
