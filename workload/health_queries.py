"""Market health queries. Windows end at the newest event; times are compressed so that the
15-minute and one-hour windows of the operators hold a month of the thin test traffic."""

from pyspark.sql import functions as F

from tidewatch.operators import health as h
from workload.registry import register

SPEED = 1000  # one hour of the health windows covers 1000 hours of the log


def events(v):
    """The log with its distance to now divided by SPEED."""
    return v.events.withColumn(
        "timestamp", F.lit(v.now) - F.floor((F.lit(v.now) - F.col("timestamp")) / F.lit(SPEED)).cast("long")
    )


PTS = f"""pts AS (SELECT ticker, id, now - (now - "timestamp") // {SPEED} AS ts, new_value AS price, event_type = 'trade' AS is_trade,
    cnt AS size, taker, new_value * cnt AS dollars FROM mk_events, cfg WHERE event_type IN ('trade', 'price_change'))"""
FLOW = f"""{PTS},
 tr AS (SELECT pts.* FROM pts, cfg WHERE is_trade AND ts >= now - 900000),
 flow AS (SELECT ticker, count(*) AS trade_count, least(1, count(*) / 15.0 / 10.0) AS trade_velocity,
   coalesce(least(1, coalesce(sum(dollars) FILTER (WHERE dollars >= 500), 0) / nullif(sum(dollars), 0)), 0) AS whale_activity
   FROM tr GROUP BY 1)"""
BOOK = """book AS (SELECT 'S' || (c_custkey % 25) || '-' || c_custkey AS ticker,
   least(1, abs(c_acctbal - (10000 - c_acctbal)) / 10000) AS orderbook_imbalance,
   greatest(0, least(1, 1 - (CAST(c_custkey % 15 AS DOUBLE) / 100) / 0.10)) AS spread_tightness
   FROM customer)"""
MOM = """pp AS (SELECT pts.* FROM pts, cfg WHERE ts >= now - 3600000),
 dl AS (SELECT *, price - lag(price) OVER (PARTITION BY ticker ORDER BY ts, id) AS dp FROM pp),
 mg AS (SELECT ticker, count(*) AS n, count(*) FILTER (WHERE dp > 0) AS u, count(*) FILTER (WHERE dp < 0) AS d,
   arg_min(price, (ts, id)) AS p0, arg_max(price, (ts, id)) AS p1 FROM dl GROUP BY 1),
 mom AS (SELECT ticker, CASE WHEN n < 3 OR u + d = 0 THEN 0 ELSE
   least(1, greatest(0, (CAST(greatest(u, d) AS DOUBLE) / (u + d) - 0.5) * 2) * (0.5 + 0.5 * least(1, abs(p1 - p0) / p0 / 0.05))) END AS momentum FROM mg)"""

register(
    "trades_enriched",
    lambda v: h.trades_enriched(v.events),
    """SELECT ticker, id, "timestamp", new_value AS price, event_type = 'trade' AS is_trade, cnt AS size,
         taker AS taker_side, new_value * cnt AS dollars FROM mk_events WHERE event_type IN ('trade', 'price_change')""",
    "price size dollars",
)


def _flow(v):
    return h.trade_flow_scores(h.recent_trades(h.trades_enriched(events(v)), v.now))


register(
    "trade_velocity",
    lambda v: _flow(v).select("ticker", "trade_count", "trade_velocity"),
    f"WITH {FLOW} SELECT ticker, trade_count, trade_velocity FROM flow",
    "trade_velocity",
)
register(
    "whale_activity",
    lambda v: _flow(v).select("ticker", "whale_activity"),
    f"WITH {FLOW} SELECT ticker, whale_activity FROM flow",
    "whale_activity",
)
register(
    "orderbook_imbalance",
    lambda v: h.orderbook_scores(v.ticker_books).select("ticker", "orderbook_imbalance"),
    f"WITH {BOOK} SELECT ticker, orderbook_imbalance FROM book",
    "orderbook_imbalance",
)
register(
    "spread_tightness",
    lambda v: h.orderbook_scores(v.ticker_books).select("ticker", "spread_tightness"),
    f"WITH {BOOK} SELECT ticker, spread_tightness FROM book",
    "spread_tightness",
)
register(
    "momentum",
    lambda v: h.momentum(h.trades_enriched(events(v)), v.now),
    f"WITH {PTS}, {MOM} SELECT * FROM mom",
    "momentum",
)
register(
    "health_scores",
    lambda v: h.health_scores(h.trades_enriched(events(v)), v.ticker_books, v.now),
    f"""WITH {FLOW}, {BOOK}, {MOM},
       j AS (SELECT coalesce(f.ticker, b.ticker) AS ticker, coalesce(trade_count, 0) AS trade_count, b.ticker IS NOT NULL AS has_orderbook,
           coalesce(trade_velocity, 0) AS trade_velocity, coalesce(orderbook_imbalance, 0) AS orderbook_imbalance,
           coalesce(whale_activity, 0) AS whale_activity, coalesce(spread_tightness, 0.5) AS spread_tightness
         FROM flow f FULL OUTER JOIN book b ON b.ticker = f.ticker)
       SELECT j.*, coalesce(momentum, 0) AS momentum, 0.25 * trade_velocity + 0.20 * orderbook_imbalance + 0.20 * whale_activity
         + 0.15 * spread_tightness + 0.20 * coalesce(momentum, 0) AS health_score FROM j LEFT JOIN mom USING (ticker)""",
    "trade_velocity orderbook_imbalance whale_activity spread_tightness momentum health_score",
)
register(
    "stale_tickers",
    lambda v: h.stale_tickers(h.trades_enriched(v.events), v.now, 5 * 86_400),
    """SELECT ticker, max("timestamp") AS last_ts FROM mk_events, cfg WHERE event_type IN ('trade', 'price_change')
       GROUP BY ticker HAVING min(now) - max("timestamp") > 432000000""",
)
