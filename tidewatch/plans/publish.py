"""Serving tables: camelCase rows of markets, anomalies, topics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import correlation, detection, markets, narrative
from tidewatch.sources.store import write_snapshot


def serving_markets(state: DataFrame, health: DataFrame | None, now_ms: int) -> DataFrame:
    """Market list rows; ``health`` (ticker, health_score) is merged where known."""
    if health is None:
        scored = state.withColumn("health_score", F.lit(None).cast("double"))
    else:
        scored = state.join(
            health.select(F.col("ticker").alias("external_id"), "health_score"), "external_id", "left"
        )
    empty = F.lit("")
    return scored.select(
        F.col("market_id").alias("marketId"),
        "platform",
        F.col("external_id").alias("externalId"),
        "title",
        F.coalesce("description", empty).alias("eventTitle"),
        F.coalesce("category", empty).alias("category"),
        F.col("end_date").alias("endDate"),
        F.col("is_active").alias("isActive"),
        F.col("last_price").alias("lastPrice"),
        F.col("last_price_ts").alias("lastPriceTs"),
        F.col("last_volume").alias("lastVolume"),
        F.col("last_volume_ts").alias("lastVolumeTs"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("rank_score", F.lit(0.0)).alias("rankScore"),
        F.col("health_score").alias("healthScore"),
        F.lit(now_ms).cast("long").alias("syncedAt"),
    )


def serving_anomalies(active: DataFrame, now_ms: int) -> DataFrame:
    empty = F.lit("")
    return narrative.anomaly_feed(active).select(
        F.col("anomaly_id").alias("anomalyId"),
        F.col("anomaly_type").alias("anomalyType"),
        "severity",
        F.col("market_count").alias("marketCount"),
        F.col("detected_at").alias("detectedAt"),
        F.coalesce("summary", empty).alias("summary"),
        F.coalesce("metadata", empty).alias("metadata"),
        F.coalesce("cluster_name", empty).alias("clusterName"),
        "catalyst",
        F.lit(now_ms).cast("long").alias("syncedAt"),
    )


def serving_topics(topics: DataFrame, now_ms: int) -> DataFrame:
    return topics.select(
        F.col("cluster_id").alias("clusterId"),
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("market_count").alias("marketCount"),
        F.col("anomaly_count").alias("anomalyCount"),
        F.coalesce("max_severity", F.lit(0.0)).alias("maxSeverity"),
        F.lit(now_ms).cast("long").alias("syncedAt"),
    )


def serving_summaries(summaries: DataFrame, now_ms: int) -> DataFrame:
    return summaries.filter("event_count > 0").select(
        F.col("market_id").alias("marketId"),
        "platform",
        "title",
        F.coalesce("category", F.lit("")).alias("category"),
        F.col("event_count").alias("eventCount"),
        F.col("first_event_ts").alias("firstEventTs"),
        F.col("last_event_ts").alias("lastEventTs"),
        F.lit(now_ms).cast("long").alias("syncedAt"),
    )


def serving_tables(tables, now_ms: int, health: DataFrame | None = None) -> dict[str, DataFrame]:
    """All four serving tables from the stored ones (``tables`` as in the detection cycle)."""
    t = tables
    return {
        "markets": serving_markets(markets.current_market_state(t.markets, now_ms), health, now_ms),
        "anomalies": serving_anomalies(
            detection.active_anomalies_view(t.anomalies, t.clusters), now_ms
        ),
        "topics": serving_topics(
            correlation.trending_topics(t.clusters, t.memberships, t.anomaly_markets, t.anomalies),
            now_ms,
        ),
        "summaries": serving_summaries(
            markets.market_summaries(t.markets, t.events, with_events_only=True), now_ms
        ),
    }


def publish(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write every serving table as one new version; readers keep the previous one meanwhile."""
    for name, df in tables.items():
        write_snapshot(df, f"{root}/{name}", version)
