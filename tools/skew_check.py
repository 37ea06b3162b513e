"""Time operators on a uniform log and on one where a single market holds a third of all rows.

``skew_check.py [rows]`` writes both logs to a new scratch folder. A skew-safe operator takes
about as long on the second as on the first.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tidewatch import configure  # noqa: E402
from tidewatch.operators import activity, candles, catalyst, detection, health, markets, quality  # noqa: E402
from tidewatch.plans import backtest  # noqa: E402

NOW = 1_767_225_600_000
DAY = 86_400_000


def write_log(spark: SparkSession, rows: int, share: float, path: str) -> None:
    kinds = "array('price_change', 'price_change', 'price_change', 'trade', 'volume_update')"
    (
        spark.range(0, rows, 1, 16)
        .selectExpr(
            "id",
            f"case when rand(1) < {share} then 7 else pmod(xxhash64(id), 20000) end as market_id",
            f"{kinds}[int(rand(2) * 5)] as event_type",
            "cast(null as double) as old_value",
            "round(0.01 + rand(3) * 0.98, 4) as new_value",
            f"{NOW} - bigint(rand(4) * {2 * DAY}) as timestamp",
        )
        .withColumn(
            "metadata",
            F.concat(F.lit('{"ticker":"T-'), F.col("market_id"), F.lit('","count":"'), F.col("id") % 900, F.lit('"}')),
        )
        .write.parquet(path)
    )


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    spark = configure(
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="skew-")
    logs = {}
    for name, share in (("uniform", 0.0), ("skewed", 1 / 3)):
        write_log(spark, rows, share, f"{root}/{name}")
        logs[name] = spark.read.parquet(f"{root}/{name}")
    dim = spark.range(20000).selectExpr(
        "id", "concat('T-', id) as external_id", "concat('M', id) as title", "'c' as category", "'kalshi' as platform",
        "true as is_active",
    )
    anomalies = spark.range(1, 200).selectExpr(
        "id as anomaly_id", "id as market_id", "1440 as window_minutes", f"{NOW - DAY} as window_start", f"{NOW} as detected_at"
    )
    operators = {
        "window_scores": lambda e: detection.window_scores(e, NOW),
        "backtest": lambda e: backtest.backtest_candidates(e, NOW, days=2, step_hours=6),
        "minute_candles": lambda e: candles.minute_candles(e, NOW),
        "recent_buffer": lambda e: quality.recent_buffer(e, NOW),
        "event_gaps": lambda e: quality.event_gaps(e, 50),
        "ordering_violations": lambda e: quality.ordering_violations(e),
        "hourly_activity": lambda e: activity.hourly_activity(e, dim, NOW),
        "newest_prices": lambda e: markets.newest_prices(e),
        "momentum": lambda e: health.momentum(health.trades_enriched(e), NOW),
        "events_of_anomalies": lambda e: catalyst.events_of_anomalies(anomalies, e),
    }
    only = sys.argv[2:] or operators
    for name in only:
        times = {}
        for log, df in logs.items():
            for _ in range(2):  # the second run is warm
                began = time.perf_counter()
                operators[name](df).write.format("noop").mode("overwrite").save()
                times[log] = time.perf_counter() - began
        print(f"{name:22s} uniform {times['uniform']:6.2f}s  skewed {times['skewed']:6.2f}s", flush=True)


if __name__ == "__main__":
    main()
