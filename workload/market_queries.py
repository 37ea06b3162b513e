"""Market dimension queries."""

from pyspark.sql import functions as F

from tidewatch.operators import markets as m
from workload.registry import register

HOUR = 3_600_000

register(
    "active_markets",
    lambda v: m.active_markets(v.markets, "kalshi").select("id", "external_id", "title"),
    "SELECT id, external_id, title FROM mk_markets WHERE is_active AND platform = 'kalshi'",
)
register(
    "lookup_markets",
    lambda v: m.lookup_markets(v.markets, v.snapshots.filter("not is_active")).select("id", "title"),
    """SELECT id, title FROM mk_markets WHERE (platform, external_id) IN
       (SELECT platform, external_id FROM mk_snapshots WHERE NOT is_active)""",
)


def _upsert(v):
    incoming = v.snapshots.unionByName(v.supplier_snapshots)
    return m.upsert_markets(v.markets, incoming, v.now)


_NEWEST = """
SELECT platform, external_id, title, category, is_active, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY platform, external_id ORDER BY snapshot_ts DESC) rn
  FROM (SELECT platform, external_id, title, category, is_active, volume, snapshot_ts FROM mk_snapshots
        UNION ALL SELECT 'kalshi', 'NEW-' || s_suppkey, s_name, 'Other', true,
          greatest(s_acctbal, CAST(0 AS DOUBLE)), now FROM supplier, cfg))
WHERE rn = 1"""

register(
    "upsert_markets",
    lambda v: _upsert(v).withColumn("known", F.col("external_id").startswith("S")).select(
        F.when(F.col("known"), F.col("id")).alias("known_id"), "platform", "external_id", "title",
        "category", "is_active", "volume", "first_seen_at", "last_updated_at", "yes_price",
    ),
    f"""SELECT k.id AS known_id, coalesce(k.platform, n.platform) AS platform,
         coalesce(k.external_id, n.external_id) AS external_id,
         CASE WHEN n.title IS NULL THEN k.title ELSE n.title END AS title,
         CASE WHEN n.title IS NULL THEN k.category ELSE n.category END AS category,
         CASE WHEN n.title IS NULL THEN k.is_active ELSE n.is_active END AS is_active,
         CASE WHEN n.title IS NULL THEN k.volume ELSE n.volume END AS volume,
         coalesce(k.first_seen_at, now) AS first_seen_at,
         CASE WHEN n.title IS NULL THEN k.last_updated_at ELSE now END AS last_updated_at,
         k.yes_price
       FROM mk_markets k FULL OUTER JOIN ({_NEWEST}) n
         ON n.platform = k.platform AND n.external_id = k.external_id, cfg""",
    "volume yes_price",
)
register(
    "upsert_new_count",
    lambda v: m.count_new(v.markets, v.snapshots.unionByName(v.supplier_snapshots)),
    f"""SELECT count(*) AS new_markets FROM ({_NEWEST}) n WHERE NOT EXISTS (
       SELECT 1 FROM mk_markets k WHERE k.platform = n.platform AND k.external_id = n.external_id)""",
)
register(
    "deactivate_stale",
    lambda v: m.deactivate_stale(v.markets, "kalshi", v.now - 2 * HOUR).select("id", "is_active"),
    """SELECT id, is_active AND NOT (platform = 'kalshi' AND last_updated_at < now - 7200000) AS is_active
       FROM mk_markets, cfg""",
)
register(
    "deactivate_expired",
    lambda v: m.deactivate_expired(v.markets, v.now).select("id", "is_active"),
    "SELECT id, is_active AND coalesce(end_ms > now, true) AS is_active FROM mk_markets, cfg",
)
register(
    "deactivate_terminal",
    lambda v: m.deactivate_terminal(v.markets, v.events).select("id", "is_active"),
    """SELECT id, is_active AND id NOT IN (SELECT market_id FROM mk_events
         WHERE event_type = 'status_change' AND lower(status) IN ('closed','determined','finalized','settled')) AS is_active
       FROM mk_markets""",
)
register(
    "latest_price_update",
    lambda v: m.apply_latest_prices(v.markets, v.events).select("id", "yes_price", "price_updated_at"),
    """WITH p AS (SELECT market_id, max("timestamp") ts, arg_min(new_value, id) price FROM (
           SELECT *, max("timestamp") OVER (PARTITION BY market_id) mx FROM mk_events
           WHERE event_type = 'price_change') WHERE "timestamp" = mx GROUP BY 1)
       SELECT id, CASE WHEN ts > price_updated_at THEN price ELSE yes_price END AS yes_price,
         CASE WHEN ts > price_updated_at THEN ts ELSE price_updated_at END AS price_updated_at
       FROM mk_markets LEFT JOIN p ON p.market_id = id""",
    "yes_price",
)
register(
    "series_markets",
    lambda v: m.series_markets(v.markets, "S7").select("id", "external_id"),
    "SELECT id, external_id FROM mk_markets WHERE is_active AND external_id LIKE 'S7-%' ORDER BY external_id",
)
register(
    "tracked_universe",
    lambda v: m.tracked_universe(v.markets, 200).select("id", "external_id", "last_updated_at"),
    """SELECT id, external_id, last_updated_at FROM mk_markets WHERE is_active
       ORDER BY last_updated_at DESC, id LIMIT 200""",
)
register(
    "universe_diff",
    lambda v: m.universe_diff(
        v.markets.filter("is_active"), v.snapshots.filter("is_active and volume >= 100000")
    ),
    """WITH c AS (SELECT external_id FROM mk_markets WHERE is_active),
         p AS (SELECT external_id FROM mk_snapshots WHERE is_active AND volume >= 100000)
       SELECT external_id, 'added' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM p)
       UNION ALL SELECT external_id, 'removed' FROM (SELECT * FROM p EXCEPT SELECT * FROM c)""",
)
register(
    "recently_active_markets",
    lambda v: m.recently_active_markets(v.events, v.now - 86_400_000),
    """SELECT DISTINCT market_id FROM mk_events, cfg WHERE "timestamp" >= now - 86400000""",
)
register(
    "discovery_change_events",
    lambda v: m.discovery_change_events(v.snapshots, v.markets, 30 * 86_400_000).drop("metadata"),
    """WITH s AS (SELECT s.market_id, s.snapshot_ts, s.yes_price,
           lag(s.yes_price) OVER (PARTITION BY s.market_id ORDER BY s.snapshot_ts) AS last
         FROM mk_snapshots s JOIN mk_markets k ON k.id = s.market_id WHERE k.is_active)
       SELECT market_id, 'new_market' AS event_type, CAST(NULL AS DOUBLE) AS old_value,
         yes_price AS new_value, snapshot_ts AS "timestamp" FROM s WHERE yes_price IS NOT NULL AND last IS NULL
       UNION ALL SELECT market_id, 'price_change', last, yes_price, snapshot_ts FROM s
         WHERE yes_price IS NOT NULL AND (last IS NULL OR yes_price <> last)""",
    "old_value new_value",
)
register(
    "discovery_seed_events",
    lambda v: m.discovery_seed_events(v.snapshots, v.markets, v.now)
    .withColumn("title", F.get_json_object("metadata", "$.title")).drop("metadata"),
    """SELECT s.market_id, 'price_change' AS event_type, CAST(NULL AS DOUBLE) AS old_value,
         s.yes_price AS new_value, now AS "timestamp", s.title
       FROM mk_snapshots s JOIN mk_markets k ON k.id = s.market_id, cfg
       WHERE k.is_active AND s.yes_price IS NOT NULL""",
    "old_value new_value",
)

STATE_SQL = """SELECT id AS market_id, platform, external_id, title, description, category, end_date,
  is_active, yes_price AS last_price, price_updated_at AS last_price_ts, volume,
  (CASE WHEN volume > 0 THEN least(ln(volume + 1) / 10, 1) ELSE 0 END) * 0.4
  + least(1 / greatest(CAST(now - price_updated_at AS DOUBLE) / 3600000, 0.1), 1) * 0.3
  + (CASE WHEN end_ms > now THEN least(1 / greatest(CAST(end_ms - now AS DOUBLE) / 86400000, 0.01), 1) ELSE 0 END) * 0.3
  AS rank_score
FROM mk_markets, cfg WHERE is_active AND yes_price IS NOT NULL"""

register(
    "current_market_state",
    lambda v: m.current_market_state(v.markets, v.now).drop("last_volume", "last_volume_ts"),
    STATE_SQL,
    "last_price volume rank_score",
)
register(
    "market_summaries",
    lambda v: m.market_summaries(v.markets, v.events),
    """SELECT k.id AS market_id, k.platform, k.title, k.category, count(e.id) AS event_count,
         min(e."timestamp") AS first_event_ts, max(e."timestamp") AS last_event_ts
       FROM mk_markets k LEFT JOIN mk_events e ON e.market_id = k.id GROUP BY 1, 2, 3, 4""",
)
register(
    "market_search",
    lambda v: m.market_search(
        m.current_market_state(v.markets, v.now), platform="kalshi", search="customer#",
        sort="volume", offset=20, limit=100,
    ).select("market_id", "title", "volume"),
    f"""SELECT market_id, title, volume FROM ({STATE_SQL}) WHERE platform = 'kalshi'
        AND contains(lower(title), 'customer#') ORDER BY volume DESC, market_id LIMIT 100 OFFSET 20""",
    "volume",
)
register(
    "market_stats",
    lambda v: m.market_stats(v.markets),
    """SELECT 'total' AS stat, '' AS name, count(*) AS n FROM mk_markets
       UNION ALL SELECT 'active', '', count(*) FILTER (WHERE is_active) FROM mk_markets
       UNION ALL SELECT 'platform', platform, count(*) FROM mk_markets GROUP BY platform
       UNION ALL SELECT 'category', category, count(*) FROM mk_markets WHERE category <> '' GROUP BY category""",
)
register(
    "event_group_top_outcomes",
    lambda v: m.event_group_top_outcomes(v.markets),
    """WITH k AS (SELECT *, split_part(external_id, '-', 1) AS event_key FROM mk_markets),
         r AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY volume DESC, id) AS rk FROM k),
         g AS (SELECT event_key, count(*) AS group_size,
                 coalesce(arg_min(description, id) FILTER (WHERE description <> ''), '') AS group_title
               FROM k GROUP BY 1)
       SELECT r.event_key, group_size, group_title, CAST(rk AS INTEGER) AS outcome_rank, id AS market_id,
         external_id, volume FROM r JOIN g USING (event_key) WHERE rk <= 10""",
    "volume",
)
register(
    "purge_orphan_markets",
    lambda v: m.purge_orphans(v.markets, v.events).select("id", "is_active"),
    """SELECT id, is_active FROM mk_markets WHERE is_active OR id IN (SELECT market_id FROM mk_events)""",
)
