"""Live ingestion: normalize and resolve a micro-batch, append it to the log, note what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.markets import market_changes
from tidewatch.session import settle
from tidewatch.sources.messages import ARRIVAL, normalize_messages, resolve_tickers, with_arrival
from tidewatch.sources.store import append_events, read_snapshot


def ingest_batch(
    raw: DataFrame,
    batch_id: int,
    tokens: DataFrame,
    markets_root: str,
    out_root: str,
    persist_price_change: bool = True,
) -> None:
    """One micro-batch, resolved against the newest published market table.

    Events and market changes go to folders named after the batch, so a repeated batch replaces
    itself. The market table is not rewritten here: ``fold_market_changes`` applies the small
    change rows whenever the table is published next.
    """
    markets = read_snapshot(raw.sparkSession, markets_root)
    # numbered as read, before the joins deal the rows anew; both platforms read the same messages
    messages = settle(with_arrival(raw))
    # both writes read the same rows; only stored ones get ids, so these run without a hole
    resolved = settle(resolve_tickers(normalize_messages(messages, tokens), markets))
    append_events(resolved, f"{out_root}/events", batch_id, persist_price_change)
    # all events, stored or not, in order of arrival
    order = F.col("arrival").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("place")
    everything = resolved.withColumn("id", order).drop(*ARRIVAL)
    market_changes(everything).write.mode("overwrite").parquet(
        f"{out_root}/market_changes/ingest_batch={batch_id}"
    )


def start_ingest(
    raw: DataFrame,
    tokens: DataFrame,
    markets_root: str,
    out_root: str,
    checkpoint: str,
    persist_price_change: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run the ingestion stream; by default one micro-batch a second."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, tokens, markets_root, out_root, persist_price_change)

    return (
        raw.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
