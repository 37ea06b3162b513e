"""Candle queries."""

from pyspark.sql import functions as F

from tidewatch.operators import candles as c
from tidewatch.session import shared_folder
from tidewatch.streaming import candles as live
from workload.registry import register

DAY = 86_400_000


def ohlcv_sql(period_ms: int, since: str) -> str:
    return f"""SELECT market_id, (b * {period_ms}) // 1000 AS time,
      arg_min(new_value, ("timestamp", id)) FILTER (WHERE p) AS open, max(new_value) FILTER (WHERE p) AS high,
      min(new_value) FILTER (WHERE p) AS low, arg_max(new_value, ("timestamp", id)) FILTER (WHERE p) AS close,
      coalesce(sum(new_value) FILTER (WHERE event_type <> 'price_change'), 0) AS volume
    FROM (SELECT *, "timestamp" // {period_ms} AS b, event_type = 'price_change' AND new_value > 0 AS p
          FROM mk_events, cfg WHERE event_type IN ('price_change', 'trade', 'volume_update')
            AND "timestamp" BETWEEN {since} AND now)
    GROUP BY market_id, b HAVING count(*) FILTER (WHERE p) > 0"""


MINUTE_SQL = """SELECT market_id, '1m' AS "interval", b * 60000 AS open_ts, b * 60000 + 60000 AS close_ts,
      arg_min(new_value, ("timestamp", id)) FILTER (WHERE p) AS open, max(new_value) FILTER (WHERE p) AS high,
      min(new_value) FILTER (WHERE p) AS low, arg_max(new_value, ("timestamp", id)) FILTER (WHERE p) AS close,
      CAST(coalesce(sum(CAST(floor(new_value) AS BIGINT)) FILTER (WHERE event_type = 'trade'), 0) AS BIGINT) AS volume,
      CAST(count(*) FILTER (WHERE event_type = 'trade') AS INTEGER) AS trade_count, min(now) AS created_at
    FROM (SELECT *, "timestamp" // 60000 AS b, event_type = 'price_change' AND new_value > 0 AS p
          FROM mk_events, cfg WHERE event_type IN ('price_change', 'trade')
            AND "timestamp" < now - now % 60000)
    GROUP BY market_id, b HAVING count(*) FILTER (WHERE p) > 0"""


def _early(v):
    return c.minute_candles(v.events.filter(F.col("timestamp") < v.now - 10 * DAY), v.now - 10 * DAY)


EARLY_SQL = MINUTE_SQL.replace("now - now % 60000", "(now - 864000000) - (now - 864000000) % 60000").replace(
    "min(now) AS created_at", "min(now) - 864000000 AS created_at"
)

register(
    "candles_ohlcv",
    lambda v: c.candles_ohlcv(v.events, v.now, 1440, start_ms=v.now - 30 * DAY),
    ohlcv_sql(86_400_000, "now - 2592000000"),
    "open high low close volume",
)
register(
    "candles_hourly_last_day",
    lambda v: c.candles_ohlcv(v.events, v.now),
    ohlcv_sql(3_600_000, "now - 86400000"),
    "open high low close volume",
)
register("candles_1m", lambda v: c.minute_candles(v.events, v.now), MINUTE_SQL, "open high low close")
register(
    "merge_candles",
    # the stored half was cut ten days ago; the newer run revises and extends it
    lambda v: c.merge_candles(
        _early(v),
        c.minute_candles(v.events, v.now).withColumn("high", F.col("high") - 0.1),
    ),
    f"""WITH s AS ({EARLY_SQL}), n AS ({MINUTE_SQL})
       SELECT coalesce(s.market_id, n.market_id) AS market_id, coalesce(s."interval", n."interval") AS "interval",
         coalesce(s.open_ts, n.open_ts) AS open_ts, coalesce(n.close_ts, s.close_ts) AS close_ts,
         coalesce(s.open, n.open) AS open, greatest(s.high, n.high - 0.1) AS high, least(s.low, n.low) AS low,
         coalesce(n.close, s.close) AS close, coalesce(n.volume, s.volume) AS volume,
         coalesce(n.trade_count, s.trade_count) AS trade_count, coalesce(s.created_at, n.created_at) AS created_at
       FROM s FULL OUTER JOIN n ON s.market_id = n.market_id AND s.open_ts = n.open_ts""",
    "open high low close",
)
register(
    "get_candles",
    lambda v: c.get_candles(c.minute_candles(v.events, v.now), 8, limit=500).drop("created_at"),
    f"""SELECT * EXCLUDE (created_at) FROM ({MINUTE_SQL}) WHERE market_id = 8 ORDER BY open_ts DESC LIMIT 500""",
    "open high low close",
)
register(
    "purge_candles",
    lambda v: c.purge_candles(
        _early(v).unionByName(c.minute_candles(v.events, v.now)), v.now - 5 * DAY
    ).select("market_id", "open_ts", "created_at"),
    f"""SELECT market_id, open_ts, created_at FROM (SELECT * FROM ({EARLY_SQL}) UNION ALL SELECT * FROM ({MINUTE_SQL})), cfg
       WHERE created_at >= now - 432000000""",
)


def _best(v):
    """Stored bars exist for older activity only; platform bars for every market with orders."""
    external = v.table("orders").selectExpr(
        "o_custkey as market_id", "unix_seconds(cast(o_orderdate as timestamp)) as time",
        "o_totalprice as open", "o_totalprice as high", "o_totalprice as low",
        "o_totalprice as close", "1D as volume",
    )
    computed = c.candles_ohlcv(v.events, v.now, 1440, start_ms=v.now - 10 * DAY)
    return c.best_source_candles(_early(v), computed, external, 1440)


BEST_SQL = f"""WITH s0 AS ({EARLY_SQL}), q0 AS ({ohlcv_sql(86_400_000, "now - 864000000")}),
  s AS (SELECT market_id, (open_ts // 86400000) * 86400000 AS time, arg_min(open, open_ts) AS open, max(high) AS high,
          min(low) AS low, arg_max(close, open_ts) AS close, CAST(sum(volume) AS DOUBLE) AS volume, 'stored' AS source
        FROM s0 GROUP BY 1, 2),
  q AS (SELECT market_id, time * 1000 AS time, open, high, low, close, volume, 'computed' AS source FROM q0
        WHERE market_id NOT IN (SELECT market_id FROM s)),
  x AS (SELECT o_custkey AS market_id, (epoch_us(o_orderdate) // 1000) AS time, o_totalprice AS open, o_totalprice AS high,
          o_totalprice AS low, o_totalprice AS close, CAST(1 AS DOUBLE) AS volume, 'external' AS source FROM orders
        WHERE o_custkey NOT IN (SELECT market_id FROM s) AND o_custkey NOT IN (SELECT market_id FROM q0))
  SELECT * FROM s UNION ALL SELECT * FROM q UNION ALL SELECT * FROM x"""
register("candles_best_source", _best, BEST_SQL, "open high low close volume")
register(
    "chart_series",
    lambda v: c.chart_series(c.candles_ohlcv(v.events, v.now, 1440, start_ms=v.now - 30 * DAY)),
    f"""SELECT *, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction
        FROM ({ohlcv_sql(86_400_000, "now - 2592000000")}) WHERE time > 0""",
    "open high low close volume",
)


def _live_bars(v):
    """The log dealt to five batches out of order, their bars put together in part, and read."""
    root = shared_folder(v.spark, "bars")
    for batch in range(5):
        live.bars_batch(v.events.filter(F.col("id") * 7 % 5 == batch), batch, root)
        if batch == 3:
            live.fold_bars(v.spark, root)
    return live.read_bars(v.spark, root, v.now)


register("live_candles", _live_bars, MINUTE_SQL, "open high low close")
