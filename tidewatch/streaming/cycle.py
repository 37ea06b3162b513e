"""Detection repeated on a schedule by a stream: every trigger runs one batch cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.quality import retention_cutoff
from tidewatch.plans.cycle import CycleConfig, Tables, detection_cycle
from tidewatch.sources import upkeep
from tidewatch.sources.store import write_anomalies


COMPACT_EVERY = 288  # cycles: a day of them


def cycle_batch(
    batch_id: int, tables: Tables, now_ms: int, root: str, config: CycleConfig,
    log_root: str | None = None, compact_every: int = COMPACT_EVERY,
) -> None:
    """Write the anomaly tables after one cycle as version ``batch_id + 1``, and keep the event log in order.

    Rows older than the retention time leave the log in every cycle (whole days by name); its small
    files are put together in every ``compact_every``-th one, which also cuts the day on the boundary.
    """
    result = detection_cycle(tables, now_ms, config)
    write_anomalies(result.anomalies, result.anomaly_markets, root, batch_id + 1)
    if log_root is None:
        return
    spark = result.anomalies.sparkSession
    cutoff = retention_cutoff(now_ms, config.retention_days)
    if cutoff is not None:
        upkeep.prune(spark, log_root, cutoff, rewrite=False)
    if (batch_id + 1) % compact_every == 0:
        upkeep.compact(spark, log_root)


def start_cycles(
    ticks: DataFrame,
    load: Callable[[int], Tables],
    clock: Callable[[], int],
    root: str,
    checkpoint: str,
    config: CycleConfig = CycleConfig(),
    every: str = "300 seconds",
    log_root: str | None = None,
) -> StreamingQuery:
    """Run a cycle per trigger over ``load(batch_id)``; ``ticks`` is the event stream that
    tells there is something new to look at, ``log_root`` the log to be maintained."""
    return (
        ticks.writeStream.foreachBatch(
            lambda _, batch: cycle_batch(batch, load(batch), clock(), root, config, log_root)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
