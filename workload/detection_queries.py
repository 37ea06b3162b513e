"""Window statistics, baselines, anomaly detection, lifecycle, reports and the backtest."""

from pyspark.sql import functions as F

from tidewatch.operators import detection as d
from tidewatch.operators import windows as w
from tidewatch.plans import backtest as bt
from tidewatch.plans import cycle
from workload.correlation_queries import MOVES_SQL
from workload.registry import register

DAY = 86_400_000
WINDOWS = (360, 1440)
LOOKBACK = 720
RULES = tuple(d.WindowRule(m) for m in WINDOWS)

# one row per (market, window, sample end): every event of a closed window [end - w, end]
SAMPLES = """
wins AS (SELECT unnest([360, 1440]) AS win),
grid AS (SELECT win, now - 2592000000 + (g + 1) * win * 60000 AS e FROM wins, cfg, range(720 * 60 // 360) r(g)
         WHERE now - 2592000000 + (g + 1) * win * 60000 <= now),
ev AS (SELECT * FROM mk_events WHERE event_type IN ('price_change', 'trade', 'volume_update')),
samples AS (
  SELECT market_id, win AS window_minutes, e AS window_end, e - win * 60000 AS window_start,
    arg_min(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change') AS price_start,
    arg_max(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change') AS price_end,
    count(*) FILTER (WHERE event_type = 'trade') AS trade_count,
    sum(new_value) FILTER (WHERE event_type = 'volume_update') AS vol,
    count(*) AS event_count
  FROM ev JOIN grid ON "timestamp" BETWEEN e - win * 60000 AND e GROUP BY 1, 2, 3, 4),
stats AS (
  SELECT market_id, window_minutes, window_start, window_end, price_start, price_end,
    price_end - price_start AS price_delta,
    CASE WHEN price_start <> 0 THEN (price_end - price_start) / price_start END AS price_change_pct,
    CASE WHEN vol IS NULL THEN CAST(trade_count AS DOUBLE) ELSE vol END AS volume_total, trade_count, event_count
  FROM samples),
base AS (
  SELECT market_id, window_minutes, coalesce(avg(price_change_pct), 0) AS pct_mean,
    coalesce(stddev_samp(price_change_pct), 0) AS pct_stddev, count(price_change_pct) AS pct_samples,
    coalesce(avg(volume_total), 0) AS volume_mean, coalesce(stddev_samp(volume_total), 0) AS volume_stddev,
    count(volume_total) AS volume_samples
  FROM stats GROUP BY 1, 2)"""
SCORES = f"""{SAMPLES},
scored AS (
  SELECT s.*, pct_mean, pct_stddev, volume_mean,
    CASE WHEN abs(price_change_pct) > 0.10 THEN least(1, log10(abs(price_change_pct) / 0.10 + 1) / log10(101)) ELSE 0 END AS price_score,
    CASE WHEN volume_total > 0 AND volume_mean > 0 AND volume_total / volume_mean > 3
      THEN least(1, volume_total / volume_mean / 6) ELSE 0 END AS volume_score,
    CASE WHEN pct_stddev > 0 AND abs(price_change_pct - pct_mean) / pct_stddev > 2.5
      THEN least(1, abs(price_change_pct - pct_mean) / pct_stddev / 5) ELSE 0 END AS zscore_score
  FROM stats s JOIN base USING (market_id, window_minutes), cfg WHERE window_end = now),
rated AS (SELECT *, CAST(printf('%.4f', CAST(greatest(price_score, volume_score, zscore_score) AS DOUBLE)) AS DOUBLE) AS severity FROM scored)"""
STAT_DOUBLES = "price_start price_end price_delta price_change_pct volume_total"

register(
    "window_stats",
    lambda v: w.window_stats(v.events, v.now, WINDOWS),
    f"WITH {SAMPLES} SELECT stats.* FROM stats, cfg WHERE window_end = now",
    STAT_DOUBLES,
)
register(
    "window_stats_short",
    lambda v: w.window_stats(v.events, v.now),
    """WITH wins AS (SELECT unnest([5, 15, 60, 1440]) AS win),
       s AS (SELECT market_id, win AS window_minutes, now - win * 60000 AS window_start, now AS window_end,
         arg_min(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change') AS price_start,
         arg_max(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change') AS price_end,
         count(*) FILTER (WHERE event_type = 'trade') AS trade_count,
         sum(new_value) FILTER (WHERE event_type = 'volume_update') AS vol, count(*) AS event_count
       FROM mk_events, wins, cfg WHERE event_type IN ('price_change', 'trade', 'volume_update')
         AND "timestamp" BETWEEN now - win * 60000 AND now GROUP BY 1, 2, 3, 4)
       SELECT market_id, window_minutes, window_start, window_end, price_start, price_end,
         price_end - price_start AS price_delta,
         CASE WHEN price_start <> 0 THEN (price_end - price_start) / price_start END AS price_change_pct,
         CASE WHEN vol IS NULL THEN CAST(trade_count AS DOUBLE) ELSE vol END AS volume_total, trade_count, event_count
       FROM s""",
    STAT_DOUBLES,
)
register(
    "baseline_stats",
    lambda v: w.baseline_stats(v.events, v.now, WINDOWS, LOOKBACK),
    f"WITH {SAMPLES} SELECT * FROM base",
    "pct_mean pct_stddev volume_mean volume_stddev",
)


def scores(v):
    return d.window_scores(v.events, v.now, RULES, LOOKBACK)


def _rule(name):
    return lambda v: scores(v).filter(F.col(name) > 0).select("market_id", "window_minutes", name)


for _name in ("price_score", "volume_score", "zscore_score"):
    register(
        f"rule_{_name.removesuffix('_score')}",
        _rule(_name),
        f"WITH {SCORES} SELECT market_id, window_minutes, {_name} FROM rated WHERE {_name} > 0",
        _name,
    )

register(
    "detect_single",
    lambda v: d.detect_single(scores(v), v.markets).drop("id", "summary"),
    f"""WITH {SCORES} SELECT market_id, window_minutes, 'single_market' AS anomaly_type, severity, window_start,
         window_end AS detected_at, price_delta,
         CASE WHEN volume_total > 0 AND volume_mean > 0 THEN CAST(printf('%.2f', CAST(volume_total / volume_mean AS DOUBLE)) AS DOUBLE) END AS volume_ratio
       FROM rated WHERE severity > 0""",
    "severity price_delta volume_ratio",
)
register(
    "detect_new",
    lambda v: d.detect_new(
        d.detect_single(scores(v), v.markets),
        d.expire_anomalies(v.anomalies, v.now - 2 * DAY), v.anomaly_markets, WINDOWS,
    ).drop("id", "summary"),
    f"""WITH {SCORES},
       busy AS (SELECT l.market_id FROM mk_anomaly_markets l JOIN mk_anomalies a ON a.id = l.anomaly_id, cfg
                WHERE a.status = 'active' AND a.detected_at >= now - 172800000),
       best AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY severity DESC, window_minutes) AS rn
                FROM rated WHERE severity > 0 AND market_id NOT IN (SELECT market_id FROM busy))
       SELECT market_id, window_minutes, 'single_market' AS anomaly_type, severity, window_start,
         window_end AS detected_at, price_delta,
         CASE WHEN volume_total > 0 AND volume_mean > 0 THEN CAST(printf('%.2f', CAST(volume_total / volume_mean AS DOUBLE)) AS DOUBLE) END AS volume_ratio
       FROM best WHERE rn = 1""",
    "severity price_delta volume_ratio",
)

register(
    "expire_anomalies",
    lambda v: d.expire_anomalies(v.anomalies, v.now - DAY).select("id", "status"),
    """SELECT id, CASE WHEN status = 'active' AND detected_at < now - 86400000 THEN 'expired' ELSE status END AS status
       FROM mk_anomalies, cfg""",
)
_A = ["id", "anomaly_type", "severity", "detected_at", "status"]
register(
    "query_anomalies",
    lambda v: d.query_anomalies(
        v.anomalies, since_ms=v.now - 20 * DAY, until_ms=v.now, status="active",
        anomaly_type="single_market", min_severity=0.3, limit=100,
    ).select(*_A),
    """SELECT id, anomaly_type, severity, detected_at, status FROM mk_anomalies, cfg
       WHERE detected_at BETWEEN now - 20 * 86400000 AND now AND status = 'active'
         AND anomaly_type = 'single_market' AND severity >= 0.3 ORDER BY detected_at DESC, id DESC LIMIT 100""",
    "severity",
)
register(
    "query_anomalies_of_market",
    lambda v: d.query_anomalies(v.anomalies, v.anomaly_markets, market_id=8).select(*_A),
    """SELECT id, anomaly_type, severity, detected_at, status FROM mk_anomalies
       WHERE id IN (SELECT anomaly_id FROM mk_anomaly_markets WHERE market_id = 8)""",
    "severity",
)
register(
    "anomaly_links",
    lambda v: d.anomaly_links(v.anomaly_markets, v.anomalies.filter("status = 'active'")),
    """SELECT * FROM mk_anomaly_markets WHERE anomaly_id IN (SELECT id FROM mk_anomalies WHERE status = 'active')""",
    "price_delta volume_ratio",
)
register(
    "update_anomalies",
    lambda v: d.update_anomalies(
        v.anomalies,
        v.anomalies.filter("severity >= 0.5").selectExpr("id", "'acknowledged' as status", "'{}' as metadata"),
    ).select("id", "status", (F.col("metadata") == "{}").alias("replaced")),
    """SELECT id, CASE WHEN severity >= 0.5 THEN 'acknowledged' ELSE status END AS status,
         CASE WHEN severity >= 0.5 THEN true WHEN meta_name IS NOT NULL THEN false END AS replaced FROM mk_anomalies""",
)
register(
    "markets_with_active_anomalies",
    lambda v: d.markets_with_active_anomalies(v.anomalies, v.anomaly_markets),
    """SELECT DISTINCT market_id FROM mk_anomaly_markets l JOIN mk_anomalies a ON a.id = l.anomaly_id WHERE status = 'active'""",
)
register(
    "active_anomalies_view",
    lambda v: d.active_anomalies_view(v.anomalies, v.clusters).drop("metadata"),
    """SELECT a.id AS anomaly_id, anomaly_type, severity, market_count, detected_at, summary, c.name AS cluster_name
       FROM mk_anomalies a LEFT JOIN mk_clusters c ON c.id = a.topic_cluster_id WHERE a.status = 'active'""",
    "severity",
)
_BUCKETS = """count(*) FILTER (WHERE severity >= 0.7) AS high,
  count(*) FILTER (WHERE severity >= 0.4 AND severity < 0.7) AS medium, count(*) FILTER (WHERE severity < 0.4) AS low"""
register(
    "anomaly_stats",
    lambda v: d.anomaly_stats(v.anomalies.filter("status = 'active'")),
    f"""SELECT count(*) AS active_count, coalesce(avg(severity), 0) AS avg_severity, {_BUCKETS}
        FROM mk_anomalies WHERE status = 'active'""",
    "avg_severity",
)
register(
    "severity_label",
    lambda v: d.with_labels(v.anomalies).select("id", "severity_label", "type_label", "type_description"),
    """SELECT id, CASE WHEN severity >= 0.7 THEN 'High' WHEN severity >= 0.4 THEN 'Medium' ELSE 'Low' END AS severity_label,
         CASE anomaly_type WHEN 'single_market' THEN 'Single Market' ELSE 'Cluster' END AS type_label,
         CASE anomaly_type WHEN 'single_market' THEN 'Unusual price or volume movement in one market'
           ELSE 'Correlated anomalies across related markets' END AS type_description FROM mk_anomalies""",
)
register(
    "alert_rate_report",
    lambda v: d.alert_rate_report(v.anomalies, v.now, 240),
    f"""SELECT count(*) AS total, {_BUCKETS}, CAST(count(*) AS DOUBLE) / 10 AS per_day,
         CASE WHEN CAST(count(*) AS DOUBLE) / 10 < 50 THEN 'PASS' ELSE 'HIGH' END AS gate
       FROM mk_anomalies, cfg WHERE detected_at >= now - 864000000""",
    "per_day",
)
register(
    "signal_report",
    lambda v: d.signal_report(v.anomalies, v.now),
    f"""SELECT *, CAST(total AS DOUBLE) / 7 AS per_day, CAST("cluster" AS DOUBLE) / 7 AS cluster_per_day,
         CASE WHEN CAST(total AS DOUBLE) / 7 < 50 THEN 'PASS' ELSE 'FAIL' END AS gate FROM (
       SELECT count(*) AS total, count(*) FILTER (WHERE anomaly_type = 'single_market') AS single_market,
         count(*) FILTER (WHERE anomaly_type = 'cluster') AS "cluster", {_BUCKETS}
       FROM mk_anomalies, cfg WHERE detected_at >= now - 604800000)""",
    "per_day cluster_per_day",
)
register(
    "signal_report_clusters",
    lambda v: d.cluster_signal_detail(v.anomalies, v.now, 30),
    """SELECT id AS anomaly_id, detected_at, coalesce(meta_name, '') AS cluster_name, market_count,
         CASE WHEN meta_name IS NULL THEN '' ELSE 'bullish' END AS direction, severity
       FROM mk_anomalies, cfg WHERE anomaly_type = 'cluster' AND detected_at >= now - 2592000000""",
    "severity",
)

# backtest: every cursor has its own closed sample windows ending at cursor - j * w
BT_RULES = (d.WindowRule(360), d.WindowRule(720))
BT = dict(days=20, step_hours=12, baseline_hours=240)
BT_SQL = """
wins AS (SELECT unnest([360, 720]) AS win),
curs AS (SELECT now - 1728000000 + 864000000 + i * 43200000 AS c FROM cfg, range(21) r(i)
         WHERE now - 1728000000 + 864000000 + i * 43200000 <= now),
ends AS (SELECT DISTINCT win, c - j * win * 60000 AS e FROM curs, wins, range(40) r(j) WHERE j < 14400 // win),
ev AS (SELECT * FROM mk_events WHERE event_type IN ('price_change', 'trade', 'volume_update')),
samples AS (
  SELECT market_id, win, e,
    arg_min(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change') AS p0,
    arg_max(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change') AS p1,
    count(*) FILTER (WHERE event_type = 'trade') AS trade_count,
    sum(new_value) FILTER (WHERE event_type = 'volume_update') AS vol
  FROM ev JOIN ends ON "timestamp" BETWEEN e - win * 60000 AND e GROUP BY 1, 2, 3),
st AS (SELECT market_id, win, e, CASE WHEN p0 <> 0 THEN (p1 - p0) / p0 END AS pct,
         CASE WHEN vol IS NULL THEN CAST(trade_count AS DOUBLE) ELSE vol END AS volume FROM samples),
per AS (SELECT a.market_id, a.win, c, a.pct, a.volume, avg(b.pct) AS pm, stddev_samp(b.pct) AS ps, avg(b.volume) AS vm
        FROM curs JOIN st a ON a.e = c JOIN st b ON b.market_id = a.market_id AND b.win = a.win
          AND b.e <= c AND b.e > c - 864000000 AND (c - b.e) % (a.win * 60000) = 0
        GROUP BY ALL),
sc AS (SELECT *, CAST(printf('%.4f', CAST(greatest(
    CASE WHEN abs(pct) > 0.10 THEN least(1, log10(abs(pct) / 0.10 + 1) / log10(101)) ELSE 0 END,
    CASE WHEN volume > 0 AND vm > 0 AND volume / vm > 3 THEN least(1, volume / vm / 6) ELSE 0 END,
    CASE WHEN ps > 0 AND abs(pct - pm) / ps > 2.5 THEN least(1, abs(pct - pm) / ps / 5) ELSE 0 END) AS DOUBLE)) AS DOUBLE) AS severity FROM per),
seen AS (SELECT DISTINCT market_id, c FROM mk_events JOIN curs ON "timestamp" BETWEEN c - 43200000 AND c),
cand AS (SELECT s.market_id, c AS cursor_ms, max(severity) AS severity,
           arg_max(win, (severity, -win)) AS window_minutes
         FROM sc s JOIN seen USING (market_id, c) WHERE severity > 0 GROUP BY 1, 2)"""
register(
    "backtest_candidates",
    lambda v: bt.backtest_candidates(v.events, v.now, BT_RULES, **BT).select(
        "market_id", "cursor_ms", "severity", "window_minutes"
    ),
    f"WITH {BT_SQL} SELECT * FROM cand",
    "severity",
)
register(
    "backtest",
    lambda v: bt.backtest_report(v.events, v.now, BT_RULES, **BT),
    f"""WITH {BT_SQL}, f AS (SELECT market_id, arg_min(severity, cursor_ms) AS severity FROM cand GROUP BY 1)
       SELECT (SELECT count(DISTINCT c) FROM seen) AS cycles, count(*) AS total, CAST(count(*) AS DOUBLE) / 20 AS per_day,
         {_BUCKETS}, CASE WHEN CAST(count(*) AS DOUBLE) / 20 < 50 THEN 'PASS' ELSE 'FAIL' END AS gate FROM f""",
    "per_day",
)
register(
    "backtest_with_expiry",
    lambda v: bt.suppress(
        bt.backtest_candidates(v.events, v.now, BT_RULES, **BT), expiry_ms=3 * DAY
    ).select("market_id", "cursor_ms", "severity"),
    # the first candidate of a market, then again and again the first one after its expiry
    f"""WITH RECURSIVE {BT_SQL},
       kept(market_id, cursor_ms) AS (
         SELECT market_id, min(cursor_ms) FROM cand GROUP BY 1
         UNION ALL
         SELECT c.market_id, min(c.cursor_ms) FROM kept k JOIN cand c
           ON c.market_id = k.market_id AND c.cursor_ms > k.cursor_ms + 259200000 GROUP BY 1)
       SELECT market_id, cursor_ms, severity FROM kept JOIN cand USING (market_id, cursor_ms)""",
    "severity",
)


# one cycle: expiry after 24 h, markets active in 5 days, correlation over 7 and series over 20 days
CYCLE_SQL = f"""WITH {SCORES}, {MOVES_SQL},
  live AS (SELECT * FROM mk_anomalies, cfg WHERE status = 'active' AND detected_at >= now - 86400000),
  busy AS (SELECT l.market_id FROM mk_anomaly_markets l JOIN live ON live.id = l.anomaly_id),
  fresh AS (SELECT market_id, max(severity) AS severity FROM rated WHERE severity > 0
    AND market_id NOT IN (SELECT market_id FROM busy)
    AND market_id IN (SELECT market_id FROM mk_events, cfg WHERE "timestamp" >= now - 432000000) GROUP BY 1),
  per AS (SELECT market_id, max(severity) AS sev FROM (
    SELECT l.market_id, live.severity FROM mk_anomaly_markets l JOIN live ON live.id = l.anomaly_id WHERE anomaly_type = 'single_market'
    UNION ALL SELECT * FROM fresh) GROUP BY 1),
  clu AS (SELECT cluster_id, (CAST(sum(round(sev * 10000)) AS BIGINT) // count(*) + CASE WHEN 2 * (CAST(sum(round(sev * 10000)) AS BIGINT) % count(*)) > count(*) OR (2 * (CAST(sum(round(sev * 10000)) AS BIGINT) % count(*)) = count(*) AND (CAST(sum(round(sev * 10000)) AS BIGINT) // count(*)) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE AS severity FROM mk_memberships JOIN per USING (market_id)
    WHERE cluster_id NOT IN (SELECT topic_cluster_id FROM mk_anomalies, cfg WHERE anomaly_type = 'cluster' AND detected_at >= now - 604800000)
    GROUP BY 1 HAVING count(*) >= 2),
  ser AS (SELECT series_prefix, count(*) AS n, count(*) FILTER (WHERE change_pct >= 0.03) AS un, count(*) FILTER (WHERE change_pct <= -0.03) AS dn,
    avg(change_pct) FILTER (WHERE change_pct >= 0.03) AS ua, avg(-change_pct) FILTER (WHERE change_pct <= -0.03) AS da FROM mv GROUP BY 1),
  srs AS (SELECT least(1, 0.5 * greatest(un, dn) / n + 0.5 * least(1, ln(1 + 100 * CASE WHEN un >= dn THEN ua ELSE da END) / 4)) AS severity
    FROM ser WHERE greatest(un, dn) >= 3),
  mem AS (SELECT m.market_id, cluster_id, platform, sev FROM mk_memberships m
    JOIN mk_markets k ON k.id = m.market_id JOIN per USING (market_id) WHERE is_active),
  pr AS (SELECT a.market_id, arg_max(b.market_id, (b.sev, -b.market_id)) AS partner_id
    FROM mem a JOIN mem b ON a.cluster_id = b.cluster_id AND a.platform <> b.platform GROUP BY 1),
  prs AS (SELECT market_id_a AS ma, market_id_b AS mb FROM mk_links
    UNION SELECT least(market_id, partner_id), greatest(market_id, partner_id) FROM pr),
  xp AS (SELECT CAST(printf('%.4f', CAST(least(1, (a.sev + b.sev) / 2 * 1.2) AS DOUBLE)) AS DOUBLE) AS severity
    FROM prs JOIN per a ON a.market_id = ma JOIN per b ON b.market_id = mb)
  SELECT 'single' AS stage, count(*) AS found, round(avg(severity), 6) AS mean_severity FROM fresh
  UNION ALL SELECT 'cluster', count(*), round(avg(severity), 6) FROM clu
  UNION ALL SELECT 'series', count(*), round(avg(severity), 6) FROM srs
  UNION ALL SELECT 'cross_platform', count(*), round(avg(severity), 6) FROM xp"""
register("detection_cycle", lambda v: cycle.cycle_counts(_cycle(v)), CYCLE_SQL, "mean_severity")


def _cycle(v):
    return cycle.detection_cycle(
        cycle.Tables(
            v.events, v.markets, v.anomalies, v.anomaly_markets, v.clusters, v.memberships, v.links
        ),
        v.now,
        cycle.CycleConfig(
            rules=RULES, baseline_hours=LOOKBACK, recent_ms=5 * DAY,
            correlation_minutes=7 * 1440, series_minutes=20 * 1440,
        ),
    )
