"""OHLCV bars: computed from the log, merged into the stored table, served from the best source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keyed import earliest, latest, merge_keyed

MINUTE_MS = 60_000


def _is_price() -> Column:
    return (F.col("event_type") == "price_change") & (F.col("new_value") > 0)


def _ohlc(is_price: Column) -> list[Column]:
    price, ts, tie = F.col("new_value"), F.col("timestamp"), F.col("id")
    return [
        earliest(price, ts, tie, is_price).alias("open"),
        F.max(F.when(is_price, price)).alias("high"),
        F.min(F.when(is_price, price)).alias("low"),
        latest(price, ts, tie, is_price).alias("close"),
    ]


def candles_ohlcv(
    events: DataFrame,
    now_ms: int,
    period_minutes: int = 60,
    start_ms: int | None = None,
    end_ms: int | None = None,
    volume: Column | None = None,
) -> DataFrame:
    """Bars of every market in [start, end] (default the last 24 h), time in epoch seconds.

    One conditional aggregation, no join. ``volume`` is the amount a trade or volume_update
    adds; the default is its event value.
    """
    end = now_ms if end_ms is None else end_ms
    start = now_ms - 86_400_000 if start_ms is None else start_ms
    period = period_minutes * MINUTE_MS
    amount = F.col("new_value") if volume is None else volume
    wanted = events.filter(
        F.col("timestamp").between(start, end)
        & F.col("event_type").isin("price_change", "trade", "volume_update")
    )
    bucket = F.floor(F.col("timestamp") / F.lit(period)).cast("long")
    return (
        wanted.groupBy("market_id", bucket.alias("bucket"))
        .agg(
            *_ohlc(_is_price()),
            F.coalesce(
                F.sum(F.when(F.col("event_type") != "price_change", amount)), F.lit(0.0)
            ).alias("volume"),
        )
        .filter(F.col("open").isNotNull())
        .select(
            "market_id",
            F.floor(F.col("bucket") * period / F.lit(1000)).cast("long").alias("time"),
            "open", "high", "low", "close", "volume",
        )
    )


def minute_bar_columns() -> list[Column]:
    """Aggregates of a one-minute bar, shared by the batch and the streaming operator."""
    is_trade = F.col("event_type") == "trade"
    return [
        *_ohlc(_is_price()),
        F.coalesce(F.sum(F.when(is_trade, F.col("new_value").cast("long"))), F.lit(0))
        .cast("long")
        .alias("volume"),
        F.count_if(is_trade).cast("int").alias("trade_count"),
    ]


def minute_candles(events: DataFrame, now_ms: int) -> DataFrame:
    """Completed one-minute bars: prices make the bar, trades its volume and count."""
    open_ts = (F.floor(F.col("timestamp") / F.lit(MINUTE_MS)) * MINUTE_MS).cast("long")
    return (
        events.filter(
            F.col("event_type").isin("price_change", "trade")
            & (F.col("timestamp") < now_ms - now_ms % MINUTE_MS)
        )
        .groupBy("market_id", open_ts.alias("open_ts"))
        .agg(*minute_bar_columns())
        .filter(F.col("open").isNotNull())
        .select(
            "market_id",
            F.lit("1m").alias("interval"),
            "open_ts",
            (F.col("open_ts") + MINUTE_MS).alias("close_ts"),
            "open", "high", "low", "close", "volume", "trade_count",
            F.lit(now_ms).cast("long").alias("created_at"),
        )
    )


def partial_bars(events: DataFrame) -> DataFrame:
    """One-minute bars of some of the events, in a form that can be put together with those of others.

    ``first`` and ``last`` are (time, id, price) of the first and last price.
    """
    open_ts = (F.floor(F.col("timestamp") / F.lit(MINUTE_MS)) * MINUTE_MS).cast("long")
    point = F.when(_is_price(), F.struct(F.col("timestamp").alias("at"), F.col("id"), F.col("new_value").alias("price")))
    price, is_trade = F.when(_is_price(), F.col("new_value")), F.col("event_type") == "trade"
    return (
        events.filter(F.col("event_type").isin("price_change", "trade"))
        .groupBy("market_id", open_ts.alias("open_ts"))
        .agg(
            F.min(point).alias("first"), F.max(point).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.coalesce(F.sum(F.when(is_trade, F.col("new_value").cast("long"))), F.lit(0)).cast("long").alias("volume"),
            F.count_if(is_trade).alias("trade_count"),
        )
    )


def joined_bars(partials: DataFrame) -> DataFrame:
    """Partial bars of the same minute put together; the order in which they came does not matter."""
    return partials.groupBy("market_id", "open_ts").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
    )


def bars_of_partials(partials: DataFrame, now_ms: int) -> DataFrame:
    """Completed one-minute bars, as :func:`minute_candles` makes them of all events at once."""
    done = partials.filter(F.col("open_ts") < now_ms - now_ms % MINUTE_MS)
    return joined_bars(done).filter(F.col("first").isNotNull()).select(
        "market_id",
        F.lit("1m").alias("interval"),
        "open_ts",
        (F.col("open_ts") + MINUTE_MS).alias("close_ts"),
        F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume",
        F.col("trade_count").cast("int").alias("trade_count"),
        F.lit(now_ms).cast("long").alias("created_at"),
    )


def merge_candles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert bars: the open stays, high/low widen, the rest is replaced."""

    def new_else_old(name: str) -> Column:
        return F.coalesce(f"inc.{name}", f"cur.{name}")

    return merge_keyed(
        stored,
        incoming,
        ["market_id", "interval", "open_ts"],
        {
            "close_ts": new_else_old("close_ts"),
            "open": F.coalesce("cur.open", "inc.open"),
            "high": F.greatest("cur.high", "inc.high"),
            "low": F.least("cur.low", "inc.low"),
            "close": new_else_old("close"),
            "volume": new_else_old("volume"),
            "trade_count": new_else_old("trade_count"),
            "created_at": F.coalesce("cur.created_at", "inc.created_at"),
        },
    )


def get_candles(
    candles: DataFrame,
    market_id: int,
    interval: str = "1m",
    since_ms: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Bars of one market, newest first; a limit cuts the list."""
    out = candles.filter((F.col("market_id") == market_id) & (F.col("interval") == interval))
    if since_ms is not None:
        out = out.filter(F.col("open_ts") >= since_ms)
    out = out.orderBy(F.col("open_ts").desc())
    return out if limit is None else out.limit(limit)


def purge_candles(candles: DataFrame, older_than_ms: int) -> DataFrame:
    """Bars written at or after the cutoff stay (by created_at, not by bar time)."""
    return candles.filter(F.col("created_at") >= older_than_ms)


def rollup_candles(candles: DataFrame, period_minutes: int) -> DataFrame:
    """Stored one-minute bars re-aggregated to a longer period; time in epoch ms."""
    period = period_minutes * MINUTE_MS
    time = (F.floor(F.col("open_ts") / F.lit(period)) * period).cast("long")
    return candles.groupBy("market_id", time.alias("time")).agg(
        F.min_by("open", "open_ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_ts").alias("close"),
        F.sum("volume").cast("double").alias("volume"),
    )


def best_source_candles(
    stored: DataFrame, computed: DataFrame, external: DataFrame, period_minutes: int = 60
) -> DataFrame:
    """Per market: stored bars, else bars computed from events, else the platform's bars.

    ``computed`` and ``external`` are (market_id, time in seconds, OHLCV); all come out in ms.
    """
    bars = ["market_id", "time", "open", "high", "low", "close", "volume"]
    first = rollup_candles(stored.filter("interval = '1m'"), period_minutes).select(*bars)
    in_ms = {"time": F.col("time") * 1000}
    second = computed.withColumns(in_ms).select(*bars)
    third = external.withColumns(in_ms).select(*bars)
    tagged = (
        first.withColumn("rank", F.lit(1))
        .unionByName(second.withColumn("rank", F.lit(2)))
        .unionByName(third.withColumn("rank", F.lit(3)))
    )
    names = F.element_at(F.array(F.lit("stored"), F.lit("computed"), F.lit("external")), F.col("rank"))
    preferred = tagged.groupBy("market_id").agg(F.min("rank").alias("preferred"))
    return (
        tagged.join(preferred, "market_id")
        .filter("rank = preferred")
        .select(*bars, names.alias("source"))
    )


def chart_series(bars: DataFrame) -> DataFrame:
    """Bars with a real time, marked up or down for the volume histogram."""
    return bars.filter(F.col("time") > 0).withColumn(
        "direction", F.when(F.col("close") >= F.col("open"), "up").otherwise("down")
    )
