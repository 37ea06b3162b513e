"""Change events from a stream of listing snapshots, with the last price of each market in a bucketed table.

A micro-batch compares its snapshots with each other and the first one of a market with the stored price.
Stored prices lie in buckets of markets; a batch reads and rewrites the buckets that it touches, under a
folder of its own, and then names the folders that hold each bucket. A batch that is run again starts
from what the batches before it named, so it gives the same.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.markets import price_change_events, price_steps
from tidewatch.session import settle
from tidewatch.sources import files

BUCKETS = 64
_LAST = "market_id long, yes_price double"


def bucket_of(market_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(market_id), F.lit(buckets)).cast("int")


def _named(spark: SparkSession, root: str, before_batch: int) -> dict[str, int]:
    """For every bucket the batch whose folder holds it, as the last batch before this one named them."""
    batches = [int(n[:-5]) for n, _ in files.listing(spark, f"{root}/_log") if n.endswith(".json")]
    last = max((b for b in batches if b < before_batch), default=None)
    return {} if last is None else json.loads(files.read_text(spark, f"{root}/_log/{last}.json"))


def last_prices(spark: SparkSession, root: str, before_batch: int, buckets: list[int] | None = None) -> DataFrame:
    """(market_id, yes_price) as of the batches before this one, of some or all buckets."""
    named = _named(spark, root, before_batch)
    paths = [f"{root}/batch={named[b]}/bucket={b}" for b in named if buckets is None or int(b) in buckets]
    return spark.read.schema(_LAST).parquet(*paths) if paths else spark.createDataFrame([], _LAST)


def discover_batch(snapshots: DataFrame, batch_id: int, markets: DataFrame, out_root: str, buckets: int = BUCKETS) -> None:
    """Write the events of one micro-batch, and the prices after it."""
    spark, state = snapshots.sparkSession, f"{out_root}/last_prices"
    steps = settle(price_steps(snapshots, markets).withColumn("bucket", bucket_of(F.col("market_id"), buckets)))
    touched = [r.bucket for r in steps.select("bucket").distinct().collect()]  # at most the number of buckets
    before = last_prices(spark, state, batch_id, touched)
    known = before.select("market_id", F.col("yes_price").alias("stored"))
    met = steps.join(known, "market_id", "left").withColumn(
        "last_price", F.when(F.col("has_last_price"), F.col("last_price")).otherwise(F.col("stored")))
    price_change_events(met).write.mode("overwrite").parquet(f"{out_root}/events/batch={batch_id}")
    if not touched:
        return
    newest = steps.groupBy("market_id").agg(F.max_by(F.struct("yes_price"), F.struct("snapshot_ts", "external_id")).alias("v"))
    after = before.join(newest, "market_id", "left_anti").unionByName(newest.select("market_id", "v.yes_price"))
    (
        after.withColumn("bucket", bucket_of(F.col("market_id"), buckets)).repartition("bucket")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={batch_id}")
    )
    named = _named(spark, state, batch_id) | {str(b): batch_id for b in touched}
    files.delete(spark, f"{state}/_log/{batch_id}.json")
    files.publish_text(spark, f"{state}/_log/{batch_id}.json", json.dumps(named))
    _sweep(spark, state, batch_id, named)


def _sweep(spark: SparkSession, state: str, batch_id: int, named: dict[str, int]) -> None:
    """Folders that neither this batch nor the one before it names go."""
    needed = {batch_id, *named.values(), *_named(spark, state, batch_id).values()}
    for name, size in files.listing(spark, state):
        if size < 0 and name.startswith("batch=") and int(name[6:]) not in needed:
            files.delete(spark, f"{state}/{name}")


def start_discovery(
    snapshots: DataFrame, markets: DataFrame, out_root: str, checkpoint: str, buckets: int = BUCKETS, trigger: dict | None = None
) -> StreamingQuery:
    """Events of known active markets under ``out_root``/events, in order of the micro-batches."""
    return (
        snapshots.writeStream.foreachBatch(lambda df, b: discover_batch(df, b, markets, out_root, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )
