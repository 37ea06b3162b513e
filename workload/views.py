"""The driver's tables seen as markets, events, clusters, anomalies and feeds.

`Views` builds them with Spark; `ORACLE_VIEWS` states the same definitions as DuckDB CTEs, so
each registered query can be checked against plain SQL over the same files. Every view covers
its whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import configure
from tidewatch.functions.keyed import with_totals

_NOW: dict[str, int] = {}

_TICKER = "concat('S', {c} % 25, '-', {c})"

_EVENT_COLUMNS = [
    "event_id as id",
    "user_id as market_id",
    """case event_type when 'click' then 'price_change' when 'view' then 'volume_update'
       when 'purchase' then 'trade' when 'signup' then 'new_market' else 'status_change' end
       as event_type""",
    """case when event_type = 'click'
       then least(0.99D, greatest(0.01D, (100 - value) / 100)) end as old_value""",
    """case when event_type in ('click', 'purchase')
       then least(0.99D, greatest(0.01D, value / 100)) else value end as new_value""",
    f"""case event_type
       when 'click' then to_json(named_struct('ticker', {_TICKER.format(c='user_id')}))
       when 'purchase' then to_json(named_struct(
           'ticker', {_TICKER.format(c='user_id')},
           'count', case when value < 1 then 'n/a' else string(bigint(value * 40)) end,
           'taker_side', case when k % 2 = 0 then 'yes' else 'no' end))
       when 'error' then to_json(named_struct(
           'ticker', {_TICKER.format(c='user_id')},
           'status', case when k = 7 then 'Settled' else 'active' end))
       end as metadata""",
    "ms as timestamp",
]


class Views:
    """Spark views over one data directory, with ``now_ms`` = time of the newest event."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def now(self) -> int:
        if self.dir not in _NOW:
            newest = F.max(F.unix_millis(F.col("ts").cast("timestamp")))
            _NOW[self.dir] = self.table("events").agg(newest).first()[0]
        return _NOW[self.dir]

    @cached_property
    def raw_events(self) -> DataFrame:
        """Driver events with milliseconds and the number in props."""
        return self.table("events").selectExpr(
            "event_id", "user_id", "event_type", "value",
            "unix_millis(cast(ts as timestamp)) as ms",
            "cast(get_json_object(props, '$.k') as int) as k",
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw_events.selectExpr(*_EVENT_COLUMNS)

    @cached_property
    def replayed_events(self) -> DataFrame:
        """The log with its status changes delivered twice."""
        return self.events.unionByName(self.events.filter("event_type = 'status_change'"))

    @cached_property
    def markets(self) -> DataFrame:
        now = self.now
        return self.table("customer").selectExpr(
            "c_custkey as id",
            "case when c_custkey % 2 = 0 then 'kalshi' else 'polymarket' end as platform",
            f"{_TICKER.format(c='c_custkey')} as external_id",
            "c_name as title",
            "case when c_custkey % 3 = 0 then '' else concat('Group ', c_custkey % 25) end as description",
            "c_mktsegment as category",
            f"""case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then 'TBD'
                else date_format(timestamp_millis({now} + (c_custkey % 60 - 10) * 86400000),
                                 "yyyy-MM-dd'T'HH:mm:ss'Z'") end as end_date""",
            "c_acctbal >= 0 as is_active",
            f"{now} - 2592000000 as first_seen_at",
            f"{now} - (c_custkey % 5) * 3600000 as last_updated_at",
            "greatest(c_acctbal, 0D) as volume",
            "case when c_custkey % 100 <> 0 then (c_custkey % 100) / 100D end as yes_price",
            f"{now} - (c_custkey % 72) * 3600000 as price_updated_at",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "bigint(n_nationkey) as id", "n_name as name",
            "concat('Region ', n_regionkey) as description",
            f"{self.now} as created_at", f"{self.now} as updated_at",
        )

    @cached_property
    def memberships(self) -> DataFrame:
        """Markets with a small positive balance stay without a cluster."""
        return self.table("customer").filter("c_acctbal < 0 or c_acctbal >= 1000").selectExpr(
            "c_custkey as market_id", "bigint(c_nationkey) as cluster_id",
            "0.5D + (c_custkey % 50) / 100D as confidence", f"{self.now} as assigned_at",
        )

    @cached_property
    def anomalies(self) -> DataFrame:
        """Errors are single-market anomalies; large signups are cluster anomalies."""
        return self.raw_events.filter(
            "event_type = 'error' or (event_type = 'signup' and value >= 150)"
        ).selectExpr(
            "event_id as id",
            "case event_type when 'error' then 'single_market' else 'cluster' end as anomaly_type",
            "round(least(1D, value / 150), 4) as severity",
            "case when event_type = 'signup' then user_id % 25 end as topic_cluster_id",
            "1 as market_count",
            "ms - 3600000 as window_start",
            "ms as detected_at",
            "concat('price ', case when event_id % 2 = 0 then '+' else '-' end) as summary",
            "case when event_id % 3 <> 0 then 'active' else 'expired' end as status",
            """case when event_type = 'signup' then to_json(named_struct(
               'cluster_name', concat('C', user_id % 25), 'direction', 'bullish')) end as metadata""",
        )

    @cached_property
    def anomaly_markets(self) -> DataFrame:
        return self.raw_events.filter("event_type = 'error'").selectExpr(
            "event_id as anomaly_id", "user_id as market_id",
            "case when event_id % 2 = 0 then value / 1000 else -value / 1000 end as price_delta",
            "value / 10 as volume_ratio",
        )

    @cached_property
    def links(self) -> DataFrame:
        """Stored links: each market with the next one, which is on the other platform."""
        c = self.table("customer").select("c_custkey")
        nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"))
        return c.join(nxt, "c_custkey", "left_semi").selectExpr(
            "c_custkey as market_id_a", "c_custkey + 1 as market_id_b",
            "0.5D + (c_custkey % 50) / 100D as confidence", "'manual' as method",
            f"{self.now} as created_at",
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Listing snapshots: one per order of the market."""
        return self.table("orders").selectExpr(
            "case when o_custkey % 2 = 0 then 'kalshi' else 'polymarket' end as platform",
            f"{_TICKER.format(c='o_custkey')} as external_id",
            "concat('Listing ', o_custkey) as title",
            "'' as description",
            "o_orderpriority as category",
            "o_orderstatus <> 'F' as is_active",
            "case when o_orderstatus <> 'P' then bigint(o_totalprice) % 5 / 10D end as yes_price",
            "cast(null as double) as no_price",
            "o_totalprice as volume",
            "cast(null as string) as end_date",
            "unix_millis(cast(o_orderdate as timestamp)) + o_orderkey as snapshot_ts",
        )

    @cached_property
    def supplier_snapshots(self) -> DataFrame:
        """Listings of markets not stored yet."""
        return self.table("supplier").selectExpr(
            "'kalshi' as platform", "concat('NEW-', s_suppkey) as external_id",
            "s_name as title", "'' as description", "'Other' as category", "true as is_active",
            "0.5D as yes_price", "0.5D as no_price", "greatest(s_acctbal, 0D) as volume",
            "cast(null as string) as end_date", f"{self.now} as snapshot_ts",
        )

    @cached_property
    def users(self) -> DataFrame:
        segments = "array('HOUSEHOLD', 'Machinery', 'FURNITURE', 'building', 'AUTOMOBILE')"
        return self.table("supplier").selectExpr(
            "concat('U', s_suppkey) as user_id",
            f"""case when s_suppkey % 6 = 5 then array()
                when s_suppkey % 4 = 0 then array({segments}[s_suppkey % 6], 'automobile')
                else array({segments}[s_suppkey % 6]) end as categories""",
            """case s_suppkey % 3 when 0 then array('Kalshi') when 1 then array('polymarket')
               else cast(null as array<string>) end as platforms""",
            "s_acctbal > 0 as alerts_enabled",
            "false as email_notifications",
        )

    @cached_property
    def feed(self) -> DataFrame:
        """Active anomalies labelled with category and platform of their market."""
        m = self.markets.select(F.col("id").alias("market_id"), "category", "platform")
        a = self.anomalies.filter("anomaly_type = 'single_market' and status = 'active'")
        label = F.when(F.col("severity") >= 0.05, F.col("category"))
        return (
            a.select(F.col("id").alias("anomaly_id"), "severity", "detected_at", "summary")
            .join(self.anomaly_markets.select("anomaly_id", "market_id"), "anomaly_id")
            .join(m, "market_id")
            .select(
                "anomaly_id", "severity", "detected_at", "summary", label.alias("cluster_name"),
                "platform",
            )
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts sent before: one per purchase, newest hour included."""
        suppliers = self.table("supplier").agg(F.count("*").alias("n"))
        return with_totals(self.raw_events.filter("event_type = 'purchase'"), suppliers).selectExpr(
            "concat('U', event_id % n) as user_id", "'anomaly' as type", "'t' as title",
            "'m' as message", "event_id as anomaly_id", "cast(null as bigint) as market_id",
            "k % 3 = 0 as is_read", "ms as created_at",
        )

    @cached_property
    def raw_messages(self) -> DataFrame:
        """Feed messages as JSON text: even users trade on one platform, odd on the other."""
        ticker = _TICKER.format(c="user_id")
        asset = "concat('T', user_id, '-', k % 2)"
        return self.raw_events.selectExpr(
            "case when user_id % 2 = 0 then 'kalshi' else 'polymarket' end as platform",
            f"""case when user_id % 2 = 0 then case event_type
              when 'click' then to_json(named_struct('type', 'ticker', 'msg', named_struct(
                'market_ticker', {ticker},
                'yes_ask_dollars', case when k % 4 <> 0 then string(value) end,
                'yes_bid_dollars', case when k % 4 = 0 then string(value) end,
                'volume_fp', string(k))))
              when 'purchase' then to_json(named_struct('type', 'trade', 'msg', named_struct(
                'market_ticker', {ticker}, 'yes_price_dollars', string(value),
                'count_fp', string(k), 'taker_side', 'yes')))
              when 'error' then to_json(named_struct('type', 'market_lifecycle_v2', 'msg',
                named_struct('market_ticker', {ticker},
                  'status', case when k % 5 = 0 then '' else 'active' end, 'result', 'no')))
              when 'signup' then to_json(named_struct('type', 'event_lifecycle', 'msg',
                named_struct('event_ticker', concat('E', user_id),
                  'type', case when k % 2 = 0 then 'created' end)))
              else concat('{{"type": "ping", "value": ', k) end
            else case event_type
              when 'click' then to_json(named_struct('event_type', 'price_change',
                'price_changes', array(
                  named_struct('asset_id', {asset}, 'best_bid', string(value),
                    'best_ask', case when k % 3 <> 0 then string(value + 2) end, 'price', '1'),
                  named_struct('asset_id', concat('X', user_id), 'best_bid', '0.5',
                    'best_ask', '0.6', 'price', '0.5'))))
              when 'purchase' then to_json(named_struct('event_type', 'last_trade_price',
                'asset_id', {asset}, 'price', case when k % 7 = 0 then 'bad' else string(value) end,
                'size', string(k), 'side', 'BUY'))
              when 'signup' then to_json(named_struct('type', 'new_market', 'market', {ticker}))
              else 'not json' end end as payload""",
            "ms as received_ms",
        )

    @cached_property
    def polymarket_listings(self) -> DataFrame:
        """Listing JSON of the odd markets (questions are the market names)."""
        now = self.now
        return self.table("customer").selectExpr(
            f"{now} as received_ms",
            f"""to_json(named_struct(
              'conditionId', {_TICKER.format(c='c_custkey')}, 'question', c_name,
              'description', repeat(c_mktsegment, 70),
              'outcomePrices', case when c_custkey % 3 = 0
                 then concat('["', (c_custkey % 120) / 100D, '", "0.1"]') end,
              'clobTokenIds', concat('["T', c_custkey, '-0", "T', c_custkey, '-1"]'),
              'lastTradePrice', case when c_custkey % 3 = 1 then (c_custkey % 90) / 100D end,
              'bestBid', (c_custkey % 50) / 100D, 'bestAsk', (c_custkey % 50) / 50D,
              'volume', c_acctbal, 'active', c_acctbal >= 0, 'closed', c_nationkey = 3,
              'endDate', date_format(timestamp_millis({now} + (c_custkey % 60 - 10) * 86400000),
                                     "yyyy-MM-dd'T'HH:mm:ss'Z'"),
              'category', case when c_mktsegment = 'BUILDING' then 'Pop Culture'
                          when c_mktsegment = 'MACHINERY' then ' Crypto ' else 'Unheard' end
            )) as payload""",
        )

    @cached_property
    def kalshi_listings(self) -> DataFrame:
        now = self.now
        return self.table("customer").selectExpr(
            f"{now} as received_ms",
            f"""to_json(named_struct(
              'ticker', {_TICKER.format(c='c_custkey')},
              'event_ticker', concat('E', c_nationkey),
              'title', c_name,
              'status', case when c_acctbal >= 0 then 'active' else 'closed' end,
              'close_time', case when c_custkey % 13 = 0 then 'TBD' else
                 date_format(timestamp_millis({now} + (c_custkey % 60 - 10) * 86400000),
                             "yyyy-MM-dd'T'HH:mm:ss'Z'") end,
              'category', case when c_mktsegment <> 'FURNITURE' then lower(c_mktsegment) end,
              'subtitle', case when c_custkey % 2 = 0 then '' else 'sub' end,
              'description', 'desc',
              'yes_ask_dollars', case when c_custkey % 4 = 0 then '0.0000'
                 else string((c_custkey % 97) / 100D) end,
              'last_price', c_custkey % 80,
              'volume_fp', case when c_custkey % 5 = 0 then '' else string(c_acctbal) end,
              'open_interest', c_custkey % 9
            )) as payload""",
        )

    @cached_property
    def orderbooks(self) -> DataFrame:
        """One book per order: its lines are levels (at most a handful per order)."""
        lines = self.table("lineitem").selectExpr(
            "l_orderkey",
            "l_returnflag = 'R' as no_side",
            "array(round(l_discount * 5 + l_tax, 4), l_quantity) as level",
        )
        return (
            lines.groupBy("l_orderkey")
            .agg(
                F.collect_list(F.when(~F.col("no_side"), F.col("level"))).alias("yes"),
                F.collect_list(F.when(F.col("no_side"), F.col("level"))).alias("no"),
            )
            .select(
                F.concat(F.lit("K"), F.col("l_orderkey")).alias("ticker"),
                F.to_json(F.struct(F.struct("yes", "no").alias("orderbook"))).alias("payload"),
                F.col("l_orderkey").alias("received_ms"),
            )
        )

    @cached_property
    def ticker_books(self) -> DataFrame:
        """Book summaries of the markets, from their balances."""
        return self.table("customer").selectExpr(
            f"{_TICKER.format(c='c_custkey')} as ticker", f"{self.now} as timestamp",
            "c_acctbal as bid_depth", "10000 - c_acctbal as ask_depth",
            "(c_custkey % 15) / 100D as spread",
        )

    @cached_property
    def rss(self) -> DataFrame:
        """One feed per document; the whole text is the description."""
        text = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
        return self.table("documents").selectExpr(
            "doc_id as feed_id",
            f"""concat('<rss><channel><title>t</title><item><title>Doc ', doc_id, ' - part - ',
              source, '</title><link>http://x/', doc_id, '</link><pubDate>day</pubDate>',
              '<description>&lt;b&gt;', {text}, '&lt;/b&gt;</description></item>',
              '<item><title>Plain ', doc_id, '</title><description>a &amp;amp; b</description>',
              '</item></channel></rss>') as payload""",
        )

    @cached_property
    def external_bars(self) -> DataFrame:
        return self.table("orders").selectExpr(
            f"{_TICKER.format(c='o_custkey')} as ticker",
            """case when o_orderstatus = 'O' then to_json(named_struct(
                 'period_begin', unix_seconds(cast(o_orderdate as timestamp)),
                 'open', o_totalprice, 'high', o_totalprice + 1, 'low', o_totalprice - 1,
                 'close', o_totalprice, 'volume', o_orderkey))
               else to_json(named_struct(
                 't', unix_seconds(cast(o_orderdate as timestamp)),
                 'open_dollars', string(o_totalprice), 'high_dollars', string(o_totalprice + 1),
                 'low_dollars', string(o_totalprice - 1), 'close_dollars', string(o_totalprice),
                 'volume_fp', string(o_orderkey))) end as payload""",
        )


ORACLE_VIEWS = """
WITH cfg AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events),
raw_ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
mk_events AS (
  SELECT event_id AS id, user_id AS market_id,
    CASE event_type WHEN 'click' THEN 'price_change' WHEN 'view' THEN 'volume_update'
      WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'new_market' ELSE 'status_change' END AS event_type,
    CASE WHEN event_type = 'click'
      THEN least(CAST(0.99 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE), (100 - value) / 100)) END AS old_value,
    CASE WHEN event_type IN ('click', 'purchase')
      THEN least(CAST(0.99 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE), value / 100)) ELSE value END AS new_value,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'S' || (user_id % 25) || '-' || user_id END AS ticker,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 1 THEN 1.0
      ELSE CAST(CAST(floor(value * 40) AS BIGINT) AS DOUBLE) END END AS cnt,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS taker,
    CASE WHEN event_type = 'error' THEN CASE WHEN k = 7 THEN 'Settled' ELSE 'active' END END AS status,
    ms AS "timestamp"
  FROM raw_ev),
mk_markets AS (
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform,
    'S' || (c_custkey % 25) || '-' || c_custkey AS external_id,
    c_name AS title,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Group ' || (c_custkey % 25) END AS description,
    c_mktsegment AS category,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'TBD' ELSE
      strftime(make_timestamp((now + (c_custkey % 60 - 10) * 86400000) * 1000), '%Y-%m-%dT%H:%M:%SZ') END AS end_date,
    CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE
      ((now + (c_custkey % 60 - 10) * 86400000) // 1000) * 1000 END AS end_ms,
    c_acctbal >= 0 AS is_active,
    now - 2592000000 AS first_seen_at,
    now - (c_custkey % 5) * 3600000 AS last_updated_at,
    greatest(c_acctbal, CAST(0 AS DOUBLE)) AS volume,
    CASE WHEN c_custkey % 100 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) / 100 END AS yes_price,
    now - (c_custkey % 72) * 3600000 AS price_updated_at
  FROM customer, cfg),
mk_clusters AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'Region ' || n_regionkey AS description FROM nation),
mk_memberships AS (
  SELECT c_custkey AS market_id, CAST(c_nationkey AS BIGINT) AS cluster_id,
    CAST(0.5 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE) / 100 AS confidence
  FROM customer WHERE c_acctbal < 0 OR c_acctbal >= 1000),
mk_anomalies AS (
  SELECT event_id AS id,
    CASE event_type WHEN 'error' THEN 'single_market' ELSE 'cluster' END AS anomaly_type,
    round(least(CAST(1 AS DOUBLE), value / 150), 4) AS severity,
    CASE WHEN event_type = 'signup' THEN user_id % 25 END AS topic_cluster_id,
    1 AS market_count, ms - 3600000 AS window_start, ms AS detected_at,
    'price ' || CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS summary,
    CASE WHEN event_id % 3 <> 0 THEN 'active' ELSE 'expired' END AS status,
    CASE WHEN event_type = 'signup' THEN 'C' || (user_id % 25) END AS meta_name
  FROM raw_ev WHERE event_type = 'error' OR (event_type = 'signup' AND value >= 150)),
mk_anomaly_markets AS (
  SELECT event_id AS anomaly_id, user_id AS market_id,
    CASE WHEN event_id % 2 = 0 THEN value / 1000 ELSE -value / 1000 END AS price_delta,
    value / 10 AS volume_ratio
  FROM raw_ev WHERE event_type = 'error'),
mk_links AS (
  SELECT c_custkey AS market_id_a, c_custkey + 1 AS market_id_b,
    CAST(0.5 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE) / 100 AS confidence
  FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)),
mk_snapshots AS (
  SELECT CASE WHEN o_custkey % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS platform,
    'S' || (o_custkey % 25) || '-' || o_custkey AS external_id, o_custkey AS market_id,
    'Listing ' || o_custkey AS title, o_orderpriority AS category, o_orderstatus <> 'F' AS is_active,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS DOUBLE) / 10 END AS yes_price,
    o_totalprice AS volume, epoch_us(o_orderdate) // 1000 + o_orderkey AS snapshot_ts
  FROM orders),
mk_users AS (
  SELECT 'U' || s_suppkey AS user_id,
    CASE WHEN s_suppkey % 6 = 5 THEN CAST([] AS VARCHAR[])
      WHEN s_suppkey % 4 = 0 THEN list_distinct([lower((['HOUSEHOLD','Machinery','FURNITURE','building','AUTOMOBILE'])[s_suppkey % 6 + 1]), 'automobile'])
      ELSE [lower((['HOUSEHOLD','Machinery','FURNITURE','building','AUTOMOBILE'])[s_suppkey % 6 + 1])] END AS categories,
    CASE s_suppkey % 3 WHEN 0 THEN ['kalshi'] WHEN 1 THEN ['polymarket'] ELSE CAST([] AS VARCHAR[]) END AS platforms,
    s_acctbal > 0 AS alerts_enabled
  FROM supplier),
mk_feed AS (
  SELECT a.id AS anomaly_id, a.severity, a.detected_at, a.summary, m.platform,
    CASE WHEN a.severity >= 0.05 THEN m.category END AS cluster_name
  FROM mk_anomalies a JOIN mk_anomaly_markets l ON l.anomaly_id = a.id
  JOIN mk_markets m ON m.id = l.market_id
  WHERE a.anomaly_type = 'single_market' AND a.status = 'active'),
mk_alerts AS (
  SELECT 'U' || (event_id % (SELECT count(*) FROM supplier)) AS user_id, event_id AS anomaly_id,
    k % 3 = 0 AS is_read, ms AS created_at
  FROM raw_ev WHERE event_type = 'purchase'),
mk_tokens AS (
  SELECT 'T' || c_custkey || '-' || i AS token_id, 'S' || (c_custkey % 25) || '-' || c_custkey AS condition_id
  FROM customer, (SELECT unnest([0, 1]) AS i) t)
"""
