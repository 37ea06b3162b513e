"""Market health from trade flow, order books and short-term momentum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.keyed import previous_by_chunk
from tidewatch.functions.text import number


def trades_enriched(events: DataFrame) -> DataFrame:
    """Trades and price changes that name a ticker, as price points; trades get a size.

    size = metadata.count, 1 when missing, empty or not a number; dollars = price x size.
    """
    wanted = events.filter(F.col("event_type").isin("trade", "price_change")).select(
        "id", "event_type", "timestamp", F.col("new_value").alias("price"), "metadata"
    )
    rows = with_parsed(wanted, "metadata", "ticker string, count string, taker_side string", "d")
    size = F.coalesce(number(F.col("d.count")), F.lit(1.0))
    is_trade = F.col("event_type") == "trade"
    return rows.filter(F.col("d.ticker") != "").select(
        F.col("d.ticker").alias("ticker"),
        "id",
        "timestamp",
        "price",
        is_trade.alias("is_trade"),
        F.when(is_trade, size).alias("size"),
        F.when(is_trade, F.coalesce("d.taker_side", F.lit("unknown"))).alias("taker_side"),
        F.when(is_trade, F.col("price") * size).alias("dollars"),
    )


def recent_trades(points: DataFrame, now_ms: int) -> DataFrame:
    """Trades of the trailing 15 minutes."""
    return points.filter(
        F.col("is_trade")
        & F.col("timestamp").between(now_ms - fv.TRADE_WINDOW_SECONDS * 1000, now_ms)
    )


def trade_flow_scores(trades: DataFrame) -> DataFrame:
    """Trade velocity and whale share per ticker from its recent trades."""
    minutes = fv.TRADE_WINDOW_SECONDS / 60.0
    whale = F.sum(F.when(F.col("dollars") >= fv.WHALE_DOLLARS, F.col("dollars")))
    return (
        trades.groupBy("ticker")
        .agg(
            F.count("*").alias("trade_count"),
            F.sum("dollars").alias("total_dollars"),
            F.coalesce(whale, F.lit(0.0)).alias("whale_dollars"),
        )
        .select(
            "ticker",
            "trade_count",
            F.least(
                F.lit(1.0), F.col("trade_count") / F.lit(minutes) / F.lit(fv.MAX_TRADES_PER_MINUTE)
            ).alias("trade_velocity"),
            F.when(
                F.col("total_dollars") != 0,
                F.least(F.lit(1.0), F.col("whale_dollars") / F.col("total_dollars")),
            ).otherwise(0.0).alias("whale_activity"),
        )
    )


def orderbook_scores(books: DataFrame) -> DataFrame:
    """Depth imbalance and spread tightness of each ticker's latest book summary."""
    fields = ["bid_depth", "ask_depth", "spread"]
    newest = books.groupBy("ticker").agg(
        F.max_by(F.struct(*fields), F.struct("timestamp", *fields)).alias("b")
    )
    depth = F.col("b.bid_depth") + F.col("b.ask_depth")
    imbalance = F.abs(F.col("b.bid_depth") - F.col("b.ask_depth")) / depth
    tight = F.lit(1.0) - F.col("b.spread") / F.lit(fv.MAX_SPREAD)
    return newest.select(
        "ticker",
        F.when(depth != 0, F.least(F.lit(1.0), imbalance)).otherwise(0.0).alias("orderbook_imbalance"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), tight)).alias("spread_tightness"),
    )


def momentum(points: DataFrame, now_ms: int) -> DataFrame:
    """One-sidedness of the price moves of the last hour, scaled by size."""
    fresh = points.filter(
        F.col("timestamp").between(now_ms - fv.PRICE_WINDOW_SECONDS * 1000, now_ms)
    ).select("ticker", "id", "timestamp", "price")
    # one minute of a ticker is sorted at a time; what joins the minutes is a row per minute
    kept = previous_by_chunk(fresh, ["ticker"], "timestamp", "id", "price", 60_000, "before")
    delta = F.col("price") - F.col("before")
    at = F.struct("timestamp", "id")
    per_ticker = kept.withColumn("delta", delta).groupBy("ticker").agg(
        F.count("*").alias("points"),
        F.count_if(F.col("delta") > 0).alias("ups"),
        F.count_if(F.col("delta") < 0).alias("downs"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
    )
    moves = F.col("ups") + F.col("downs")
    one_sided = F.greatest("ups", "downs") / F.nullif(moves, F.lit(0).cast("long"))
    base = F.greatest(F.lit(0.0), (one_sided - 0.5) * 2.0)
    first, last = F.col("first_price"), F.col("last_price")
    boost = F.least(F.lit(1.0), F.abs(last - first) / first / fv.FULL_MOMENTUM_MOVE)
    scaled = F.when(first > 0, F.least(F.lit(1.0), base * (boost * 0.5 + 0.5))).otherwise(base)
    score = F.when((F.col("points") >= 3) & (moves > 0), scaled).otherwise(0.0)
    return per_ticker.select("ticker", score.alias("momentum"))


def health_scores(
    points: DataFrame,
    books: DataFrame,
    now_ms: int,
    tickers: DataFrame | None = None,
    top: int | None = None,
) -> DataFrame:
    """Weighted health of every ticker with recent trades or an order book."""
    flow = trade_flow_scores(recent_trades(points, now_ms))
    book = orderbook_scores(books).withColumn("has_orderbook", F.lit(True))
    out = (
        flow.join(book, "ticker", "full_outer")
        .join(momentum(points, now_ms), "ticker", "left")
        .select(
            "ticker",
            F.coalesce("trade_count", F.lit(0).cast("long")).alias("trade_count"),
            F.coalesce("has_orderbook", F.lit(False)).alias("has_orderbook"),
            F.coalesce("trade_velocity", F.lit(0.0)).alias("trade_velocity"),
            F.coalesce("orderbook_imbalance", F.lit(0.0)).alias("orderbook_imbalance"),
            F.coalesce("whale_activity", F.lit(0.0)).alias("whale_activity"),
            F.coalesce("spread_tightness", F.lit(0.5)).alias("spread_tightness"),
            F.coalesce("momentum", F.lit(0.0)).alias("momentum"),
        )
    )
    total = F.lit(0.0)
    for name, weight in fv.HEALTH_WEIGHTS.items():
        total = total + F.col(name) * weight
    out = out.withColumn("health_score", total)
    if tickers is not None:
        out = out.join(tickers.select("ticker"), "ticker", "left_semi")
    if top is not None:
        out = out.orderBy(F.col("health_score").desc(), "ticker").limit(top)
    return out


def stale_tickers(points: DataFrame, now_ms: int, max_age_seconds: int = 3600) -> DataFrame:
    """Tickers without a trade or price for longer than ``max_age_seconds``."""
    return (
        points.groupBy("ticker")
        .agg(F.max("timestamp").alias("last_ts"))
        .filter(F.lit(now_ms) - F.col("last_ts") > max_age_seconds * 1000)
    )
