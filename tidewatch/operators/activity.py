"""Trading-hours activity and throughput reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import round_exact
from tidewatch.functions.keyed import with_totals

HOUR_MS = 3_600_000


def _new_york(ts_ms: Column) -> Column:
    """Local wall-clock time in New York, whatever the session time zone is."""
    return F.convert_timezone(
        F.lit("UTC"), F.lit("America/New_York"),
        F.timestamp_add("MILLISECOND", ts_ms, F.expr("timestamp_ntz'1970-01-01 00:00:00'")),
    )


def hourly_activity(events: DataFrame, markets: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Activity by hour, New York hour and weekday, category and event type.

    Events shrink to one row per (hour, market, type) before they meet the dimension; those
    rows are unique per market, so the distinct market count is a plain count. New York is a
    whole number of hours from UTC, so local hour and weekday follow from the bucket.
    """
    is_price = F.col("event_type") == "price_change"
    move = F.abs(F.col("new_value") - F.coalesce("old_value", "new_value"))
    per_market = (
        events.filter(F.col("timestamp") > now_ms - days * 86_400_000)
        .groupBy(
            (F.floor(F.col("timestamp") / F.lit(HOUR_MS)).cast("long") * HOUR_MS).alias("hour_bucket"),
            "market_id",
            "event_type",
        )
        .agg(
            F.count("*").alias("n"),
            F.sum(F.when(is_price, move)).alias("moves"),
            F.count_if(is_price).alias("prices"),
        )
    )
    category = markets.select(F.col("id").alias("market_id"), "category")
    local = _new_york(F.col("hour_bucket"))
    return (
        per_market.join(category, "market_id", "inner")
        .groupBy("hour_bucket", "category", "event_type")
        .agg(
            F.sum("n").alias("event_count"),
            F.count("*").alias("active_markets"),
            (F.sum("moves") / F.nullif(F.sum("prices"), F.lit(0))).alias("avg_price_delta"),
        )
        .select(
            "hour_bucket",
            F.hour(local).alias("hour_et"),
            (F.dayofweek(local) - 1).alias("day_of_week"),
            "category",
            "event_type",
            "event_count",
            "active_markets",
            "avg_price_delta",
            F.when(F.col("event_type") == "trade", F.col("event_count"))
            .otherwise(F.lit(0))
            .cast("long")
            .alias("trade_count"),
        )
    )


def peak_hours(hourly: DataFrame) -> DataFrame:
    """Mean activity per New York hour; hours without activity are zero; bar is relative."""
    per_hour = hourly.groupBy("hour_et").agg(
        F.avg("event_count").alias("avg_events"), F.avg("active_markets").alias("avg_markets")
    )
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_et"))
    zero = F.lit(0.0)
    per_hour = with_totals(
        hours.join(per_hour, "hour_et", "left"), per_hour.agg(F.max("avg_events").alias("top"))
    )
    return per_hour.select(
        "hour_et",
        F.coalesce("avg_events", zero).alias("avg_events"),
        F.coalesce("avg_markets", zero).alias("avg_markets"),
        F.when(F.col("top") > 0, F.coalesce("avg_events", zero) / F.col("top"))
        .otherwise(zero)
        .alias("bar"),
    )


def category_activity(hourly: DataFrame) -> DataFrame:
    """Total events and the mean of the distinct market counts seen per category."""
    named = hourly.withColumn(
        "category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Unknown"))
    )
    per_count = named.groupBy("category", "active_markets").agg(F.sum("event_count").alias("n"))
    return per_count.groupBy("category").agg(
        F.sum("n").alias("total_events"), F.avg("active_markets").alias("avg_markets")
    )


def weekday_weekend(hourly: DataFrame) -> DataFrame:
    weekend = F.col("day_of_week").isin(0, 6)
    return hourly.groupBy(F.when(weekend, "weekend").otherwise("weekday").alias("period")).agg(
        F.sum("event_count").alias("total_events"), F.avg("event_count").alias("avg_per_bucket")
    )


def throughput(events: DataFrame, now_ms: int, window_seconds: int = 60) -> DataFrame:
    """Events per second over the trailing window."""
    recent = events.filter(F.col("timestamp").between(now_ms - window_seconds * 1000, now_ms))
    return recent.agg(
        F.count("*").alias("window_events"),
        round_exact(F.count("*") / F.lit(float(window_seconds)), 2).alias("events_per_second"),
    )


def throughput_series(events: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Events per second in each tumbling window of the log (batch or streaming)."""
    width = window_seconds * 1000
    start = (F.floor(F.col("timestamp") / F.lit(width)) * width).cast("long")
    return events.groupBy(start.alias("window_start")).agg(
        F.count("*").alias("window_events"),
        (F.count("*") / F.lit(float(window_seconds))).alias("events_per_second"),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("category").agg(F.count("*").alias("errors"))
