"""Feed normalization, sinks and serving tables."""

from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.pricing import category_from_title, kalshi_yes_price, polymarket_yes_price, standard_category
from tidewatch.operators import detection, markets as mk
from tidewatch.operators import correlation as k
from tidewatch.plans import publish as p
from tidewatch.session import shared_folder
from tidewatch.sources import catalogs, feeds, messages, store
from workload.market_queries import STATE_SQL
from workload.registry import register


def _title_case_sql(groups, column: str) -> str:
    """CASE over keyword groups, from the fixed lists."""
    whens = []
    for category, words in groups:
        tests = " OR ".join("contains({0}, '{1}')".format(column, w.replace("'", "''")) for w in words)
        whens.append(f"WHEN {tests} THEN '{category}'")
    return f"CASE {' '.join(whens)} ELSE '{fv.DEFAULT_CATEGORY}' END"


K_CASE = _title_case_sql(fv.KALSHI_TITLE_KEYWORDS, "lower(t)")
P_CASE = _title_case_sql(fv.POLYMARKET_TITLE_KEYWORDS, "lower(t)")
TICKER = "'S' || (c_custkey % 25) || '-' || c_custkey"
END = """CASE WHEN c_custkey % 13 = 0 THEN true ELSE (c_custkey % 60 - 10) > 0 END"""
END_TEXT = "strftime(make_timestamp((now + (c_custkey % 60 - 10) * 86400000) * 1000), '%Y-%m-%dT%H:%M:%SZ')"

# yes_ask_dollars unless zero, else last_price in cents, else nothing
K_PRICE = """CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 97 > 0 THEN CAST(c_custkey % 97 AS DOUBLE) / 100
  WHEN c_custkey % 80 > 1 THEN CAST(c_custkey % 80 AS DOUBLE) / 100 WHEN c_custkey % 80 = 1 THEN 1.0 END"""
P_PRICE = """CASE WHEN c_custkey % 3 = 0 THEN least(1, CAST(c_custkey % 120 AS DOUBLE) / 100)
  WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 90 AS DOUBLE) / 100
  ELSE (CAST(c_custkey % 50 AS DOUBLE) / 100 + CAST(c_custkey % 50 AS DOUBLE) / 50) / 2 END"""

register(
    "norm_kalshi_market",
    lambda v: catalogs.normalize_kalshi_listing(v.kalshi_listings, v.now).drop("snapshot_ts"),
    f"""SELECT 'kalshi' AS platform, {TICKER} AS external_id, c_name AS title,
         CASE WHEN c_custkey % 2 = 0 THEN 'desc' ELSE 'sub' END AS description,
         CASE WHEN c_mktsegment <> 'FURNITURE' THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE {K_CASE} END AS category,
         true AS is_active, {K_PRICE} AS yes_price, 1 - ({K_PRICE}) AS no_price,
         CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal ELSE c_custkey % 9 END AS volume,
         CASE WHEN c_custkey % 13 = 0 THEN 'TBD' ELSE {END_TEXT} END AS end_date, 'E' || c_nationkey AS event_ticker
       FROM (SELECT *, c_name AS t FROM customer), cfg WHERE c_acctbal >= 0 AND {END}""",
    "yes_price no_price volume",
)
register(
    "norm_polymarket_market",
    lambda v: catalogs.normalize_polymarket_listing(v.polymarket_listings, v.now).drop("snapshot_ts"),
    f"""SELECT 'polymarket' AS platform, {TICKER} AS external_id, c_name AS title,
         repeat(c_mktsegment, 70) AS description,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Entertainment' WHEN 'MACHINERY' THEN 'Cryptocurrency' ELSE {P_CASE} END AS category,
         true AS is_active, {P_PRICE} AS yes_price, 1 - ({P_PRICE}) AS no_price, c_acctbal AS volume, {END_TEXT} AS end_date
       FROM (SELECT *, c_name AS t FROM customer), cfg WHERE c_acctbal >= 0 AND c_nationkey <> 3 AND (c_custkey % 60 - 10) > 0""",
    "yes_price no_price volume",
)
register(
    "kalshi_yes_price",
    # the six price fields, taken from order lines
    lambda v: v.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        kalshi_yes_price([F.lit(None).cast("string"), (F.col("l_discount") * 0.5).cast("string"), F.col("l_tax").cast("string"),
                          F.col("l_quantity").cast("string"), F.lit("bad"), F.lit("3")]).alias("yes_price"),
    ),
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount * 0.5 WHEN l_tax > 0 THEN l_tax
         WHEN l_quantity > 1 THEN l_quantity / 100 WHEN l_quantity > 0 THEN l_quantity ELSE 0.03 END AS yes_price FROM lineitem""",
    "yes_price",
)
register(
    "polymarket_yes_price",
    lambda v: v.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        polymarket_yes_price(
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit('["'), F.col("l_discount"), F.lit('"]'))).when(
                F.col("l_returnflag") == "A", F.lit("broken")),
            F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")),
            F.col("l_tax").cast("string"), F.col("l_discount").cast("string"),
        ).alias("yes_price"),
    ),
    """SELECT l_orderkey, l_linenumber, least(1, CASE WHEN l_returnflag = 'R' THEN l_discount
         WHEN l_linestatus = 'O' THEN l_quantity ELSE (l_tax + l_discount) / 2 END) AS yes_price FROM lineitem""",
    "yes_price",
)
for _platform, _case in (("kalshi", K_CASE), ("polymarket", P_CASE)):
    register(
        f"category_from_title_{_platform}",
        lambda v, pf=_platform: v.table("documents").select("doc_id", category_from_title(F.col("text"), pf).alias("category")),
        f"SELECT doc_id, {_case} AS category FROM (SELECT doc_id, text AS t FROM documents)",
    )
register(
    "category_standardize",
    lambda v: v.table("documents").select(
        "doc_id",
        standard_category(F.when(F.col("lang") != "en", F.concat(F.lit(" "), F.col("lang"), F.lit("-tv & x "))), F.col("text"), "kalshi").alias("category"),
    ),
    f"""SELECT doc_id, CASE WHEN lang <> 'en' THEN upper(lang[1]) || lang[2:] || '-Tv & X' ELSE {K_CASE} END AS category
        FROM (SELECT *, text AS t FROM documents)""",
)
_EVENT_DIM = "n_nationkey <> 4"
register(
    "enrich_event_metadata",
    lambda v: catalogs.enrich_with_event_metadata(
        catalogs.normalize_kalshi_listing(v.kalshi_listings, v.now),
        v.table("nation").selectExpr(
            "concat('E', n_nationkey) as event_ticker",
            "case when n_regionkey > 1 then lower(n_name) else '' end as category",
            "case when n_regionkey <> 2 then concat('Ev ', n_name) end as title",
        ),
    ).select("external_id", "title", "description", "category"),
    f"""SELECT {TICKER} AS external_id, CASE WHEN n_regionkey <> 2 THEN d ELSE c_name END AS title,
         CASE WHEN n_regionkey <> 2 THEN 'Ev ' || n_name ELSE d END AS description,
         CASE WHEN n_regionkey > 1 THEN array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(n_name, ' ')], ' ')
           WHEN c_mktsegment <> 'FURNITURE' THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE {K_CASE} END AS category
       FROM (SELECT *, c_name AS t, CASE WHEN c_custkey % 2 = 0 THEN 'desc' ELSE 'sub' END AS d FROM customer)
         JOIN nation ON n_nationkey = c_nationkey, cfg WHERE c_acctbal >= 0 AND {END}""",
)


def _taxonomy(v):
    return v.table("part").selectExpr(
        "p_partkey as doc_id",
        """to_json(named_struct('categories', array(named_struct('name', concat(' ', p_type, ' '), 'tags', array(p_name, 'Crypto')),
             named_struct('name', p_brand, 'tags', array(p_name))))) as payload""",
    )


register(
    "taxonomy_flatten",
    lambda v: catalogs.flatten_taxonomy(_taxonomy(v), catalogs.known_kalshi_categories(v.spark)),
    """WITH w AS (SELECT p_partkey, 0 AS pos, 0 AS wp, lower(p_name) AS keyword, p_type AS c FROM part
         UNION ALL SELECT p_partkey, 0, 2, lower(p_type), p_type FROM part
         UNION ALL SELECT p_partkey, 1, 0, lower(p_name), p_brand FROM part
         UNION ALL SELECT p_partkey, 1, 1, lower(p_brand), p_brand FROM part)
       SELECT keyword, upper(c[1]) || lower(c[2:]) AS category
       FROM (SELECT keyword, arg_min(c, (p_partkey, pos, wp)) AS c FROM w GROUP BY 1)""",
)
register("token_map", lambda v: catalogs.token_map(v.polymarket_listings), "SELECT token_id, condition_id FROM mk_tokens")
register(
    "tickers_to_tokens",
    lambda v: catalogs.tickers_to_tokens(v.markets.filter("is_active"), catalogs.token_map(v.polymarket_listings)),
    "SELECT condition_id, token_id FROM mk_tokens WHERE condition_id IN (SELECT external_id FROM mk_markets WHERE is_active)",
)

UNIT = "CASE WHEN value > 1 THEN value / 100 ELSE value END"
USER = "'S' || (user_id % 25) || '-' || user_id"
MSG = {
    "kalshi_ticker": ("price_change", f"SELECT ms, 'price_change' AS event_type, {UNIT} AS new_value, {USER} AS ticker FROM raw_ev WHERE event_type = 'click' AND user_id % 2 = 0"),
    "kalshi_trade": ("trade", f"SELECT ms, 'trade' AS event_type, {UNIT} AS new_value, {USER} AS ticker FROM raw_ev WHERE event_type = 'purchase' AND user_id % 2 = 0"),
    "kalshi_lifecycle": ("status_change", f"SELECT ms, 'status_change' AS event_type, CAST(0 AS DOUBLE) AS new_value, {USER} AS ticker FROM raw_ev WHERE event_type = 'error' AND user_id % 2 = 0"),
    "kalshi_event_lifecycle": ("status_change", "SELECT ms, 'status_change' AS event_type, CAST(0 AS DOUBLE) AS new_value, 'E' || user_id AS ticker FROM raw_ev WHERE event_type = 'signup' AND user_id % 2 = 0"),
    "polymarket_trade": ("trade", f"SELECT ms, 'trade' AS event_type, value AS new_value, {USER} AS ticker FROM raw_ev WHERE event_type = 'purchase' AND user_id % 2 = 1 AND k % 7 <> 0"),
    "polymarket_price": ("price_change", f"SELECT ms, 'price_change' AS event_type, CASE WHEN k % 3 <> 0 THEN value + 1 ELSE value END AS new_value, {USER} AS ticker FROM raw_ev WHERE event_type = 'click' AND user_id % 2 = 1"),
    "polymarket_new_market": ("new_market", f"SELECT ms, 'new_market' AS event_type, CAST(0 AS DOUBLE) AS new_value, {USER} AS ticker FROM raw_ev WHERE event_type = 'signup' AND user_id % 2 = 1"),
}


def _normalized(v):
    return messages.normalize_messages(v.raw_messages, catalogs.token_map(v.polymarket_listings))


def _shown(df):
    ticker = F.coalesce(F.get_json_object("metadata", "$.ticker"), F.get_json_object("metadata", "$.event_ticker"))
    return df.select(F.col("timestamp").alias("ms"), "event_type", "new_value", ticker.alias("ticker"))


def _of_kind(name, kind):
    grouped = "event_ticker" if name == "kalshi_event_lifecycle" else "ticker"

    def run(v):
        if name.startswith("kalshi"):
            df = messages.normalize_kalshi_messages(v.raw_messages)
        else:
            df = messages.normalize_polymarket_messages(v.raw_messages, catalogs.token_map(v.polymarket_listings))
        has = F.get_json_object("metadata", f"$.{grouped}").isNotNull()
        return _shown(df.filter((F.col("event_type") == kind) & has))

    return run


for _name, (_kind, _sql) in MSG.items():
    register(f"norm_{_name}", _of_kind(_name, _kind), _sql, "new_value")
register(
    "normalize_messages",
    lambda v: _shown(_normalized(v)),
    " UNION ALL ".join(sql for _, sql in MSG.values()),
    "new_value",
)
register(
    "resolve_tickers",
    lambda v: messages.resolve_tickers(_normalized(v), v.markets).select("market_id", F.col("timestamp").alias("ms"), "event_type"),
    f"""SELECT k.id AS market_id, ms, event_type FROM ({' UNION ALL '.join(sql for _, sql in MSG.values())}) e
        JOIN mk_markets k ON k.external_id = e.ticker WHERE k.is_active""",
)
register(
    "orderbook_summary",
    lambda v: feeds.orderbook_summary(v.orderbooks),
    """WITH l AS (SELECT l_orderkey, l_returnflag = 'R' AS no_side, round(l_discount * 5 + l_tax, 4) AS p, l_quantity AS q FROM lineitem),
       g AS (SELECT l_orderkey, coalesce(sum(q) FILTER (WHERE NOT no_side), 0) AS bid_depth, coalesce(sum(q) FILTER (WHERE no_side), 0) AS ask_depth,
           greatest(0, max(p) FILTER (WHERE NOT no_side)) AS bid, least(1, min(1 - p) FILTER (WHERE no_side)) AS ask,
           count(*) FILTER (WHERE NOT no_side) AS yes_n, count(*) FILTER (WHERE no_side) AS no_n FROM l GROUP BY 1),
       b AS (SELECT *, CASE WHEN yes_n = 0 THEN greatest(0, ask - 0.02) ELSE bid END AS best_bid,
           CASE WHEN no_n = 0 THEN least(1, bid + 0.02) ELSE ask END AS best_ask FROM g)
       SELECT 'K' || l_orderkey AS ticker, l_orderkey AS "timestamp", bid_depth, ask_depth, best_bid, best_ask,
         CAST(yes_n + no_n AS INTEGER) AS levels, greatest(0, best_ask - best_bid) AS spread FROM b""",
    "bid_depth ask_depth best_bid best_ask spread",
)
register(
    "rss_news_items",
    lambda v: feeds.rss_news_items(v.rss),
    """SELECT doc_id AS feed_id, 0 AS item_pos, 'Doc ' || doc_id || ' - part' AS title, source, 'day' AS published_at,
         'http://x/' || doc_id AS url, trim(text, ' ') AS snippet FROM documents
       UNION ALL SELECT doc_id, 1, 'Plain ' || doc_id, '', '', '', 'a & b' FROM documents""",
)
register(
    "external_candles",
    lambda v: feeds.external_candles(v.external_bars),
    """SELECT 'S' || (o_custkey % 25) || '-' || o_custkey AS ticker, epoch_us(o_orderdate) // 1000000 AS time, o_totalprice AS open,
         o_totalprice + 1 AS high, o_totalprice - 1 AS low, o_totalprice AS close, CAST(o_orderkey AS DOUBLE) AS volume FROM orders""",
    "open high low close volume",
)
register(
    "bulk_copy_rekeyed",
    lambda v: _rekeyed(v),
    """SELECT k.id AS market_id, c.name AS cluster_name, m.confidence FROM mk_memberships m
         JOIN mk_markets k ON k.id = m.market_id JOIN mk_clusters c ON c.id = m.cluster_id""",
    "confidence",
)


def _rekeyed(v):
    """Another store with shifted ids copied into ours: natural keys must survive."""
    shifted = {
        "markets": v.markets.withColumn("id", F.col("id") + 1_000_000),
        "events": v.events.withColumn("market_id", F.col("market_id") + 1_000_000),
        "clusters": v.clusters.withColumn("id", F.col("id") + 500),
        "memberships": v.memberships.withColumn("market_id", F.col("market_id") + 1_000_000).withColumn(
            "cluster_id", F.col("cluster_id") + 500),
    }
    out = store.rekeyed_copy(shifted, v.markets)
    names = out["clusters"].select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"))
    return out["memberships"].join(names, "cluster_id").select("market_id", "cluster_name", "confidence")




def _archived(v):
    """The hourly archive, written and read back."""
    root = shared_folder(v.spark, "archive")
    store.archive_events(v.events, root)
    return v.spark.read.schema(f"{_schema(v.events)}, date date, hour int").json(root)


def _schema(df):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


register(
    "event_archive",
    lambda v: _archived(v).groupBy(F.col("date").cast("string").alias("date"), F.col("hour").cast("int").alias("hour"))
    .agg(F.count("*").alias("archived")),
    """SELECT strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d') AS date,
         CAST(hour(make_timestamp("timestamp" * 1000)) AS INTEGER) AS hour, count(*) AS archived FROM mk_events GROUP BY 1, 2""",
)
register(
    "publish_markets",
    lambda v: p.serving_markets(
        mk.current_market_state(v.markets, v.now), v.ticker_books.selectExpr("ticker", "spread as health_score"), v.now
    ).drop("lastVolume", "lastVolumeTs", "endDate"),
    f"""SELECT market_id AS marketId, platform, external_id AS externalId, title, coalesce(description, '') AS eventTitle,
         coalesce(category, '') AS category, is_active AS isActive, last_price AS lastPrice, last_price_ts AS lastPriceTs,
         volume, rank_score AS rankScore, CAST(c_custkey % 15 AS DOUBLE) / 100 AS healthScore, now AS syncedAt
       FROM ({STATE_SQL}) s JOIN customer ON c_custkey = market_id, cfg""",
    "lastPrice volume rankScore healthScore",
)
register(
    "publish_anomalies",
    lambda v: p.serving_anomalies(detection.active_anomalies_view(v.anomalies, v.clusters), v.now).drop("metadata", "catalyst"),
    """SELECT a.id AS anomalyId, anomaly_type AS anomalyType, severity, market_count AS marketCount, detected_at AS detectedAt,
         summary, coalesce(c.name, '') AS clusterName, now AS syncedAt
       FROM mk_anomalies a LEFT JOIN mk_clusters c ON c.id = topic_cluster_id, cfg WHERE status = 'active'""",
    "severity",
)
register(
    "publish_topics",
    lambda v: p.serving_topics(k.trending_topics(v.clusters, v.memberships, v.anomaly_markets, v.anomalies), v.now),
    """SELECT c.id AS clusterId, c.name, c.description, count(DISTINCT m.market_id) AS marketCount,
         count(DISTINCT a.id) AS anomalyCount, coalesce(max(a.severity), 0) AS maxSeverity, max(now) AS syncedAt
       FROM mk_clusters c LEFT JOIN mk_memberships m ON m.cluster_id = c.id LEFT JOIN mk_anomaly_markets l ON l.market_id = m.market_id
         LEFT JOIN mk_anomalies a ON a.id = l.anomaly_id AND a.status = 'active', cfg GROUP BY 1, 2, 3""",
    "maxSeverity",
)
register(
    "publish_summaries",
    lambda v: p.serving_summaries(mk.market_summaries(v.markets, v.events), v.now),
    """SELECT k.id AS marketId, platform, title, coalesce(category, '') AS category, count(*) AS eventCount,
         min(e."timestamp") AS firstEventTs, max(e."timestamp") AS lastEventTs, max(now) AS syncedAt
       FROM mk_markets k JOIN mk_events e ON e.market_id = k.id, cfg GROUP BY 1, 2, 3, 4""",
)
