"""Why a market moved: price, trade flow, bursts and the catalyst they point to.

All operators take ``anomaly_events``: all events in each anomaly's window
(:func:`events_of_anomalies`). Whatever is keyed by anomaly is a partial aggregate; bursts are
swept over the trades per millisecond, in chunks as wide as a burst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.keyed import earliest, latest
from tidewatch.functions.text import iso_millis, number, series_prefix

ANOMALY_KEYS = ("anomaly_id", "market_id", "window_minutes", "window_start", "detected_at")
BUCKET_MS = 21_600_000  # the join of events and anomalies meets per market and six hours


def events_of_anomalies(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each anomaly's market inside [window_start, detected_at].

    ``anomalies`` has the columns of ANOMALY_KEYS. An equi-join on market and span of time, so a
    busy market meets only the anomalies of the span at hand and is dealt over its spans.
    """
    span = lambda ts: F.floor(ts / F.lit(BUCKET_MS)).cast("long")
    bounds = anomalies.select(
        *ANOMALY_KEYS,
        F.explode(F.sequence(span(F.col("window_start")), span(F.col("detected_at")))).alias("span"),
    )
    log = events.select(
        "id", "market_id", "event_type", "new_value", "metadata", "timestamp",
        span(F.col("timestamp")).alias("span"),
    )
    return log.join(bounds, ["market_id", "span"]).filter(
        F.col("timestamp").between(F.col("window_start"), F.col("detected_at"))
    ).drop("span")


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _price_ends(when: Column) -> list[Column]:
    v, ts, tie = F.col("new_value"), F.col("timestamp"), F.col("id")
    return [
        earliest(v, ts, tie, when).alias("price_from"), latest(v, ts, tie, when).alias("price_to")
    ]


def _move_columns() -> dict[str, Column]:
    first, last = F.col("price_from"), F.col("price_to")
    change = F.when(first > 0, (last - first) / first)
    direction = F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")
    return {
        "magnitude_pct": F.coalesce(F.abs(change), F.lit(0.0)),
        "direction": direction.otherwise("unknown"),
    }


def price_move(anomaly_events: DataFrame) -> DataFrame:
    """First and last price, size and direction of the move per anomaly."""
    return (
        anomaly_events.filter(_is("price_change"))
        .groupBy("anomaly_id")
        .agg(*_price_ends(F.lit(True)))
        .withColumns(_move_columns())
    )


def _with_sizes(anomaly_events: DataFrame) -> DataFrame:
    size = F.coalesce(number(F.col("d.count")), F.lit(1.0))
    return with_parsed(
        anomaly_events, "metadata", "count string, taker_side string", "d"
    ).withColumns({"size": size, "dollars": F.col("new_value") * size})


def _flow_sums(when: Column) -> list[Column]:
    dollars = F.when(when, F.col("dollars"))
    return [
        F.count_if(when).alias("trade_count"),
        F.sum(dollars).alias("total"),
        F.coalesce(F.sum(F.when(dollars >= fv.WHALE_DOLLARS, dollars)), F.lit(0.0)).alias("whale"),
        F.coalesce(F.sum(F.when(F.col("d.taker_side") == "yes", dollars)), F.lit(0.0)).alias("buys"),
        F.avg(F.when(when, F.col("size"))).alias("avg_trade_size"),
    ]


def _flow_columns() -> dict[str, Column]:
    total = F.when(F.col("total") > 0, F.col("total"))
    return {
        "trades_per_minute": F.col("trade_count") / F.greatest("window_minutes", F.lit(1)),
        "whale_trade_pct": F.coalesce(F.col("whale") / total, F.lit(0.0)),
        "taker_buy_pct": F.coalesce(F.col("buys") / total, F.lit(0.0)),
    }


def trade_flow(anomaly_events: DataFrame) -> DataFrame:
    """Trade counts, whale share, taker side and mean size per anomaly."""
    return (
        _with_sizes(anomaly_events.filter(_is("trade")))
        .groupBy("anomaly_id", "window_minutes")
        .agg(*_flow_sums(F.lit(True)))
        .withColumns(_flow_columns())
        .select(
            "anomaly_id", "trade_count", "trades_per_minute", "whale_trade_pct", "taker_buy_pct",
            "avg_trade_size",
        )
    )


def _bursts(per_ms: DataFrame) -> DataFrame:
    """The fullest interval of a fifth of the window that starts at a trade, per anomaly.

    ``per_ms`` has one row per anomaly and millisecond with trades (``n``). An interval from a trade
    ends in the trade's chunk or the next one, so each chunk is swept together with the rows of
    the next. In time order the trades up to an interval's end (``upto``), less those before its
    start, are the trades inside.
    """
    width = F.floor(F.col("window_minutes") * 60_000 * F.lit(fv.BURST_WINDOW_FRACTION)).cast("long")
    chunk = F.floor((F.col("timestamp") - F.col("window_start")) / F.col("width")).cast("long")
    own = per_ms.withColumn("width", width).withColumn("chunk", chunk)
    both = own.select(
        "*", F.explode(F.array(
            F.struct(F.col("chunk").alias("sweep"), F.lit(True).alias("own")),
            F.struct((F.col("chunk") - 1).alias("sweep"), F.lit(False).alias("own")),
        )).alias("c")
    ).select("anomaly_id", "timestamp", "n", "width", "c.sweep", "c.own").filter("sweep >= 0")
    sweep = ["anomaly_id", "sweep"]
    earlier = Window.partitionBy(*sweep).orderBy("timestamp").rangeBetween(Window.unboundedPreceding, -1)
    itself = F.struct(F.col("timestamp").alias("at"), F.lit(0).alias("is_end"))
    end = F.struct((F.col("timestamp") + F.col("width")).alias("at"), F.lit(1).alias("is_end"))
    rows = both.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        *sweep, "timestamp", "n", "before",
        F.explode(F.when(F.col("own"), F.array(itself, end)).otherwise(F.array(itself))).alias("m"),
    ).select(*sweep, "timestamp", "n", "before", "m.at", "m.is_end")
    so_far = (
        Window.partitionBy(*sweep).orderBy("at", "is_end")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    trade = F.col("is_end") == 0
    ends = rows.withColumns({
        "inside": F.sum(F.when(trade, F.col("n"))).over(so_far) - F.col("before"),
        "last_at": F.max(F.when(trade, F.col("at"))).over(so_far),
    }).filter("is_end = 1")
    best = F.max(F.struct(F.col("inside").alias("n"), (-F.col("timestamp")).alias("start"), "last_at"))
    return ends.groupBy("anomaly_id").agg(best.alias("b"))


def _burst_columns() -> dict[str, Column]:
    share = F.col("b.n") / F.nullif(F.col("trade_count"), F.lit(0).cast("long"))
    hit = (F.col("trade_count") >= fv.BURST_MIN_TRADES) & (share >= fv.BURST_TRADE_SHARE)
    hit = F.coalesce(hit, F.lit(False))
    seconds = (F.col("b.last_at") + F.col("b.start")) / 1000.0
    return {
        "burst_detected": hit,
        "burst_trade_pct": F.when(hit, share).otherwise(0.0),
        "burst_duration_seconds": F.when(hit, seconds).otherwise(0.0),
    }


_MS_KEYS = ("anomaly_id", "window_minutes", "window_start", "timestamp")


def burst_detection(anomaly_events: DataFrame) -> DataFrame:
    """Largest share of an anomaly's trades inside one fifth of its window."""
    per_ms = anomaly_events.filter(_is("trade")).groupBy(*_MS_KEYS).agg(F.count("*").alias("n"))
    counts = per_ms.groupBy("anomaly_id").agg(F.sum("n").alias("trade_count"))
    return (
        counts.join(_bursts(per_ms), "anomaly_id")
        .withColumns(_burst_columns())
        .select("anomaly_id", "burst_detected", "burst_trade_pct", "burst_duration_seconds")
    )


def event_signals(anomaly_events: DataFrame) -> DataFrame:
    """Price move, trade flow and burst of every anomaly from one join with the log.

    Events are first summed up per anomaly and millisecond; the totals and the bursts are both
    made of that, and Spark reuses its exchange.
    """
    trade, dollars = _is("trade"), F.when(_is("trade"), F.col("dollars"))
    price = F.when(_is("price_change"), F.struct("timestamp", "id"))
    value = F.struct(F.col("new_value").alias("v"))
    per_ms = _with_sizes(anomaly_events).groupBy(*_MS_KEYS).agg(
        F.count_if(trade).alias("n"),
        F.sum(dollars).alias("total"),
        F.sum(F.when(dollars >= fv.WHALE_DOLLARS, dollars)).alias("whale"),
        F.sum(F.when(F.col("d.taker_side") == "yes", dollars)).alias("buys"),
        F.sum(F.when(trade, F.col("size"))).alias("sizes"),
        F.min_by(value, price).alias("first"),
        F.max_by(value, price).alias("last"),
    )
    at = F.when(F.col("first").isNotNull(), F.col("timestamp"))
    totals = per_ms.groupBy("anomaly_id", "window_minutes").agg(
        F.min_by("first.v", at).alias("price_from"),
        F.max_by("last.v", at).alias("price_to"),
        F.sum("n").alias("trade_count"),
        F.sum("total").alias("total"),
        F.coalesce(F.sum("whale"), F.lit(0.0)).alias("whale"),
        F.coalesce(F.sum("buys"), F.lit(0.0)).alias("buys"),
        F.sum("sizes").alias("sizes"),
    )
    return (
        totals.join(_bursts(per_ms.filter("n > 0")), "anomaly_id", "left")
        .withColumn("avg_trade_size", F.col("sizes") / F.nullif(F.col("trade_count"), F.lit(0).cast("long")))
        .withColumns({**_move_columns(), **_flow_columns(), **_burst_columns()})
        .drop("window_minutes", "total", "whale", "buys", "sizes", "b")
    )


def market_context(
    anomalies: DataFrame, markets: DataFrame, with_expiry: bool = False
) -> DataFrame:
    """Category and series of the anomalous market; hours to its end only on request."""
    dim = markets.select(
        F.col("id").alias("market_id"), "title", "category", "external_id", "end_date"
    )
    hours = (iso_millis(F.col("end_date")) - F.col("detected_at")) / 3_600_000.0
    return anomalies.join(dim, "market_id", "left").select(
        "anomaly_id",
        "window_minutes",
        F.coalesce("title", F.concat(F.lit("market "), F.col("market_id"))).alias("title"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce(series_prefix(F.col("external_id")), F.lit("")).alias("series_prefix"),
        (hours if with_expiry else F.lit(None).cast("double")).alias("hours_to_expiry"),
        F.lit(0).cast("long").alias("markets_in_series"),
    )


def catalyst_columns() -> dict[str, Column]:
    """catalyst_type and confidence from the signals, first matching rule wins."""
    whale, n, mag = F.col("whale_trade_pct"), F.col("trade_count"), F.col("magnitude_pct")
    is_whale = (whale >= 0.5) & (n >= 3)
    is_news = F.col("burst_detected") & (F.col("burst_trade_pct") >= 0.7)
    is_momentum = (n >= 10) & (whale < 0.3) & (mag >= 0.05)
    is_late = F.coalesce(F.col("hours_to_expiry") < 4, F.lit(False)) & (mag >= 0.1)
    pace = F.least(F.lit(1.0), F.col("trades_per_minute") / 5.0)
    confidence = (
        F.when(is_whale, whale * 0.4 + 0.3)
        .when(is_news, F.col("burst_trade_pct") * 0.3 + 0.4)
        .when(is_momentum, pace * 0.3 + 0.3)
        .when(is_late, 0.5)
        .otherwise(0.1)
    )
    return {
        "catalyst_type": F.when(is_whale, "whale").when(is_news, "news")
        .when(is_momentum, "momentum").when(is_late, "pre_resolution").otherwise("unknown"),
        "confidence": F.least(F.lit(1.0), confidence),
    }


def catalyst_analysis(
    anomalies: DataFrame, anomaly_events: DataFrame, markets: DataFrame, with_expiry: bool = False
) -> DataFrame:
    """All signals of every anomaly in one row, with the catalyst they suggest."""
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    return (
        market_context(anomalies, markets, with_expiry)
        .join(event_signals(anomaly_events), "anomaly_id", "left")
        .withColumns(
            {
                "direction": F.coalesce("direction", F.lit("unknown")),
                "trade_count": F.coalesce("trade_count", none),
                "burst_detected": F.coalesce("burst_detected", F.lit(False)),
                **{
                    c: F.coalesce(c, zero)
                    for c in (
                        "magnitude_pct", "trades_per_minute", "whale_trade_pct", "taker_buy_pct",
                        "avg_trade_size", "burst_duration_seconds", "burst_trade_pct",
                    )
                },
            }
        )
        .withColumns(catalyst_columns())
    )


def reply_cost(calls: DataFrame) -> DataFrame:
    """Requests, tokens and dollars over a table of model calls."""
    return calls.agg(
        F.count("*").alias("total_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
    ).withColumn(
        "total_cost_usd",
        F.col("total_input_tokens") * fv.INPUT_TOKEN_COST / 1_000_000
        + F.col("total_output_tokens") * fv.OUTPUT_TOKEN_COST / 1_000_000,
    )
