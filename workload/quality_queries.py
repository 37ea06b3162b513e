"""Event log, integrity, retention and activity queries."""

from pyspark.sql import functions as F

from tidewatch.operators import activity as act
from tidewatch.operators import quality as q
from tidewatch.session import shared_folder
from tidewatch.sources import catalogs, store, upkeep
from tidewatch.streaming import ingest
from workload.feed_queries import MSG
from workload.registry import register

DAY = 86_400_000
GAP = 600_000
EVENT_COLS = ["id", "market_id", "event_type", "new_value", "timestamp"]
_COLS = 'id, market_id, event_type, new_value, "timestamp"'

register(
    "get_events",
    lambda v: q.get_events(v.events, event_type="trade", since_ms=v.now - 20 * DAY, limit=1000).select(*EVENT_COLS),
    f"""SELECT {_COLS} FROM mk_events, cfg WHERE event_type = 'trade' AND "timestamp" >= now - 20 * 86400000
        ORDER BY "timestamp" DESC, id DESC LIMIT 1000""",
    "new_value",
)
register(
    "events_in_window",
    lambda v: q.events_in_window(v.events, "price_change", v.now - 10 * DAY, v.now).select(*EVENT_COLS),
    f"""SELECT {_COLS} FROM mk_events, cfg WHERE event_type = 'price_change'
        AND "timestamp" BETWEEN now - 864000000 AND now""",
    "new_value",
)
register(
    "store_counts",
    lambda v: q.store_counts(v.markets, v.events, v.now - 5 * DAY, v.now),
    """SELECT (SELECT count(*) FROM mk_markets) AS market_count, count(*) AS event_count,
         min("timestamp") AS min_ts, max("timestamp") AS max_ts,
         count(*) FILTER (WHERE "timestamp" BETWEEN now - 432000000 AND now) AS in_range
       FROM mk_events, cfg""",
)
register(
    "duplicate_events",
    lambda v: q.duplicate_events(v.replayed_events),
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
         SELECT count(*) AS n FROM (SELECT * FROM mk_events UNION ALL
           SELECT * FROM mk_events WHERE event_type = 'status_change')
         GROUP BY market_id, event_type, "timestamp", new_value HAVING count(*) > 1)""",
)
register(
    "event_gaps",
    lambda v: q.event_gaps(v.events, GAP),
    f"""SELECT start_ts, end_ts, end_ts - start_ts AS duration_ms FROM (
         SELECT "timestamp" AS start_ts, lead("timestamp") OVER (ORDER BY "timestamp") AS end_ts FROM mk_events)
       WHERE end_ts - start_ts >= {GAP}""",
)
register(
    "ordering_violations",
    # ids counted per arrival of the previous hour, so that some order is really violated
    lambda v: q.ordering_violations(
        v.events.withColumn("timestamp", F.col("timestamp") - (F.col("market_id") % 7) * 600_000)
    ),
    """WITH e AS (SELECT id, "timestamp" - (market_id % 7) * 600000 AS ts FROM mk_events)
       SELECT count(*) AS violations FROM e b JOIN e a ON a.id = b.id - 1 WHERE b.ts < a.ts""",
)
register(
    "event_type_distribution",
    lambda v: q.event_type_distribution(v.events),
    "SELECT event_type, count(*) AS event_count FROM mk_events GROUP BY 1",
)
register(
    "prune_events",
    lambda v: q.prune_events(v.events, v.now - 7 * DAY).select(*EVENT_COLS),
    f"""SELECT {_COLS} FROM mk_events, cfg WHERE "timestamp" >= now - 604800000""",
    "new_value",
)
register(
    "prune_preview",
    lambda v: q.prune_preview(v.events, v.now - 7 * DAY),
    """SELECT count(*) AS would_prune FROM mk_events, cfg WHERE "timestamp" < now - 604800000""",
)
register(
    "purge_by_type",
    lambda v: q.purge_by_type(v.events, "price_change", v.now - 7 * DAY).select("id"),
    """SELECT id FROM mk_events, cfg
       WHERE NOT (event_type = 'price_change' AND "timestamp" < now - 604800000)""",
)
register(
    "event_age_histogram",
    lambda v: q.age_histogram(v.events, v.now),
    """SELECT event_type, CASE WHEN "timestamp" >= now - 604800000 THEN 'recent' ELSE 'old' END AS age,
         count(*) AS event_count FROM mk_events, cfg GROUP BY 1, 2""",
)
register(
    "integrity_report",
    lambda v: q.integrity_report(v.replayed_events, GAP),
    f"""WITH e AS (SELECT * FROM mk_events UNION ALL SELECT * FROM mk_events WHERE event_type = 'status_change'),
         t AS (SELECT CAST(count(*) AS DOUBLE) AS n,
                CAST(max("timestamp") - min("timestamp") AS DOUBLE) / 3600000 AS h FROM e),
         d AS (SELECT CAST(coalesce(sum(n - 1), 0) AS DOUBLE) AS x FROM (SELECT count(*) AS n FROM e
                GROUP BY market_id, event_type, "timestamp", new_value HAVING count(*) > 1)),
         g AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM (
                SELECT lead("timestamp") OVER (ORDER BY "timestamp") - "timestamp" AS w FROM e) WHERE w >= {GAP}),
         o AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM mk_events b JOIN mk_events a ON a.id = b.id - 1
                WHERE b."timestamp" < a."timestamp")
       SELECT 'total_events' AS check_name, n AS value, CASE WHEN n >= 100000 THEN 'PASS' ELSE 'WARN' END AS status FROM t
       UNION ALL SELECT 'duration_hours', h, CASE WHEN h >= 72 THEN 'PASS' ELSE 'WARN' END FROM t
       UNION ALL SELECT 'gate', CASE WHEN n >= 100000 AND h >= 72 THEN 1.0 ELSE 0.0 END,
         CASE WHEN n >= 100000 AND h >= 72 THEN 'PASS' ELSE 'NOT MET' END FROM t
       UNION ALL SELECT 'duplicate_events', x, CASE WHEN x = 0 THEN 'PASS' ELSE 'WARN' END FROM d
       UNION ALL SELECT 'gaps', x, CASE WHEN x = 0 THEN 'PASS' ELSE 'WARN' END FROM g
       UNION ALL SELECT 'ordering_violations', x, CASE WHEN x = 0 THEN 'PASS' ELSE 'WARN' END FROM o""",
    "value",
)
register(
    "store_stats_report",
    lambda v: q.store_stats_report(v.markets, v.events),
    """SELECT 'markets' AS stat, '' AS name, count(*) AS value FROM mk_markets
       UNION ALL SELECT 'events', '', count(*) FROM mk_events
       UNION ALL SELECT 'first_ts', '', min("timestamp") FROM mk_events
       UNION ALL SELECT 'last_ts', '', max("timestamp") FROM mk_events
       UNION ALL SELECT 'event_type', event_type, count(*) FROM mk_events GROUP BY event_type""",
)
_BUFFER = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY "timestamp" DESC, id DESC) AS rn
  FROM mk_events, cfg WHERE "timestamp" BETWEEN now - 1296000000 AND now)"""
register(
    "recent_buffer",
    lambda v: q.recent_buffer(v.events, v.now, max_age_ms=15 * DAY).select(*EVENT_COLS),
    f"SELECT {_COLS} FROM ({_BUFFER})",
    "new_value",
)
register(
    "buffer_stats",
    lambda v: q.buffer_stats(q.recent_buffer(v.events, v.now, max_age_ms=15 * DAY), v.now),
    f"""SELECT CAST(count(*) AS BIGINT) AS total_events, count(DISTINCT market_id) AS markets,
         max(now - "timestamp") AS oldest_age_ms, min(now - "timestamp") AS newest_age_ms,
         (SELECT max(c) FROM (SELECT count(*) AS c FROM ({_BUFFER}) GROUP BY market_id)) AS largest_market
       FROM ({_BUFFER})""",
)
register(
    "latest_event",
    lambda v: q.latest_event(v.events.select(*EVENT_COLS)),
    f"""SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY "timestamp" DESC, id DESC) AS rn
        FROM mk_events) WHERE rn = 1""",
    "new_value",
)


def _hourly(v):
    return act.hourly_activity(v.events, v.markets, v.now)


HOURLY = """SELECT ("timestamp" // 3600000) * 3600000 AS hour_bucket,
    CAST(hour(timezone('America/New_York', timezone('UTC', make_timestamp("timestamp" * 1000)))) AS INTEGER) AS hour_et,
    CAST(dayofweek(timezone('America/New_York', timezone('UTC', make_timestamp("timestamp" * 1000)))) AS INTEGER) AS day_of_week,
    k.category, e.event_type, count(*) AS event_count, count(DISTINCT e.market_id) AS active_markets,
    avg(CASE WHEN e.event_type = 'price_change' THEN abs(new_value - coalesce(old_value, new_value)) END) AS avg_price_delta,
    CAST(sum(CASE WHEN e.event_type = 'trade' THEN 1 ELSE 0 END) AS BIGINT) AS trade_count
  FROM mk_events e JOIN mk_markets k ON k.id = e.market_id, cfg
  WHERE e."timestamp" > now - 604800000 GROUP BY 1, 2, 3, 4, 5"""
register("hourly_activity", _hourly, HOURLY, "avg_price_delta")
register(
    "peak_hours",
    lambda v: act.peak_hours(_hourly(v)),
    f"""WITH h AS ({HOURLY}),
         p AS (SELECT hour_et, avg(event_count) AS ae, avg(active_markets) AS am FROM h GROUP BY 1)
       SELECT CAST(r.x AS INTEGER) AS hour_et, coalesce(ae, 0) AS avg_events, coalesce(am, 0) AS avg_markets,
         coalesce(ae, 0) / (SELECT max(ae) FROM p) AS bar
       FROM range(24) r(x) LEFT JOIN p ON p.hour_et = r.x""",
    "avg_events avg_markets bar",
)
register(
    "category_activity",
    lambda v: act.category_activity(_hourly(v)),
    f"""SELECT coalesce(nullif(category, ''), 'Unknown') AS category, CAST(sum(event_count) AS BIGINT) AS total_events,
         avg(DISTINCT active_markets) AS avg_markets FROM ({HOURLY}) GROUP BY 1""",
    "avg_markets",
)
register(
    "weekday_weekend",
    lambda v: act.weekday_weekend(_hourly(v)),
    f"""SELECT CASE WHEN day_of_week IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS period,
         CAST(sum(event_count) AS BIGINT) AS total_events, avg(event_count) AS avg_per_bucket
       FROM ({HOURLY}) GROUP BY 1""",
    "avg_per_bucket",
)
register(
    "throughput",
    lambda v: act.throughput(v.events, v.now, 3600),
    """SELECT count(*) AS window_events, CAST(printf('%.2f', CAST(count(*) / 3600.0 AS DOUBLE)) AS DOUBLE) AS events_per_second
       FROM mk_events, cfg WHERE "timestamp" BETWEEN now - 3600000 AND now""",
    "events_per_second",
)
register(
    "throughput_series",
    lambda v: act.throughput_series(v.events),
    """SELECT ("timestamp" // 60000) * 60000 AS window_start, count(*) AS window_events,
         CAST(count(*) AS DOUBLE) / 60 AS events_per_second FROM mk_events GROUP BY 1""",
    "events_per_second",
)
register(
    "error_counts",
    lambda v: act.error_counts(
        v.raw_events.filter("event_type = 'error'").selectExpr("concat('code', k % 5) as category")
    ),
    "SELECT 'code' || (k % 5) AS category, count(*) AS errors FROM raw_ev WHERE event_type = 'error' GROUP BY 1",
)


def _stored(events, prices=True):
    """The log after it was written in order of the ids, without them, and read back."""
    root = shared_folder(events.sparkSession, "log")
    store.append_events(events.orderBy("id").drop("id"), root, 1, prices)
    return store.read_events(events.sparkSession, root, with_date=True)


register(
    "appended_ordering_violations",
    lambda v: q.ordering_violations(_stored(v.events)),
    """SELECT count(*) AS violations FROM (SELECT "timestamp" AS t, lag("timestamp") OVER (ORDER BY id) AS p FROM mk_events) WHERE t < p""",
)
def _ingested(v):
    """The feed in order of time, ingested with every join shuffled, and read back."""
    spark, root = v.spark, shared_folder(v.spark, "ingest")
    store.write_markets(v.markets, f"{root}/markets", 0)
    known = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(known)
    spark.conf.set(known, "-1")
    try:
        tokens = catalogs.token_map(v.polymarket_listings)
        ingest.ingest_batch(v.raw_messages.orderBy("received_ms"), 0, tokens, f"{root}/markets", f"{root}/out")
    finally:
        spark.conf.set(known, before)
    return store.read_events(spark, f"{root}/out/events")


register(
    "ingested_ordering_violations",
    # ids are 0, 1, 2, ... in the order of the feed, whatever the joins did to the rows
    lambda v: q.ordering_violations(events := _ingested(v)).crossJoin(
        events.agg(F.count("*").alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    ),
    f"""SELECT CAST(0 AS BIGINT) AS violations, count(*) AS events, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id
        FROM ({' UNION ALL '.join(sql for _, sql in MSG.values())}) e JOIN mk_markets k ON k.external_id = e.ticker WHERE k.is_active""",
)


def _kept_log(v, prune_first):
    """The log written in seven batches, compacted and pruned, and read back."""
    root = shared_folder(v.spark, "log")
    for batch in range(7):
        store.append_events(v.events.filter(F.col("id") % 7 == batch), root, batch)
    cutoff = v.now - 10 * DAY
    if prune_first:
        upkeep.prune(v.spark, root, cutoff)
        upkeep.compact(v.spark, root)
    else:
        upkeep.compact(v.spark, root)
        upkeep.prune(v.spark, root, cutoff, rewrite=False)
    return store.read_events(v.spark, root).select(*EVENT_COLS)


for _name, _first in (("pruned_and_compacted_log", True), ("compacted_and_pruned_log", False)):
    register(
        _name,
        lambda v, first=_first: _kept_log(v, first),
        f'SELECT {_COLS} FROM mk_events, cfg WHERE "timestamp" >= now - 864000000',
        "new_value",
    )
register(
    "append_events",
    lambda v: _stored(v.events, False).groupBy("event_type", F.col("event_date").cast("string").alias("event_date"))
    .agg(F.count("*").alias("stored")),
    """SELECT event_type, strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d') AS event_date, count(*) AS stored
       FROM mk_events WHERE event_type <> 'price_change' GROUP BY 1, 2""",
)
