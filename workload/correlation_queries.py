"""Cluster, series and cross-platform correlation queries."""

from pyspark.sql import functions as F

from tidewatch.operators import correlation as k
from workload.registry import register

DAY_MIN = 1440
DAY = 86_400_000
WEEK_MIN = 7 * DAY_MIN

# per market: active single-market anomalies of the last 7 days
PER_MARKET = """per AS (SELECT l.market_id, max(a.severity) AS sev,
    count(*) FILTER (WHERE summary LIKE '%+%') AS ups, count(*) FILTER (WHERE summary LIKE '%-%') AS downs
  FROM mk_anomaly_markets l JOIN mk_anomalies a ON a.id = l.anomaly_id, cfg
  WHERE anomaly_type = 'single_market' AND status = 'active' AND detected_at >= now - 604800000 GROUP BY 1)"""


def _dir(u: str, d: str) -> str:
    return (f"CASE WHEN {u} > 0 AND {d} = 0 THEN 'bullish' WHEN {d} > 0 AND {u} = 0 THEN 'bearish' "
            f"WHEN {u} > 0 AND {d} > 0 THEN 'mixed' ELSE 'undetermined' END")


CLUSTER_SQL = f"""WITH {PER_MARKET},
  c AS (SELECT cluster_id, CAST(count(*) AS INTEGER) AS market_count, (CAST(sum(round(sev * 10000)) AS BIGINT) // count(*) + CASE WHEN 2 * (CAST(sum(round(sev * 10000)) AS BIGINT) % count(*)) > count(*) OR (2 * (CAST(sum(round(sev * 10000)) AS BIGINT) % count(*)) = count(*) AND (CAST(sum(round(sev * 10000)) AS BIGINT) // count(*)) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE AS severity,
          sum(ups) AS u, sum(downs) AS d FROM mk_memberships m JOIN per USING (market_id) GROUP BY 1 HAVING count(*) >= 2)
  SELECT 'cluster' AS anomaly_type, severity, cluster_id AS topic_cluster_id, market_count, {_dir('u', 'd')} AS direction
  FROM c WHERE cluster_id NOT IN (SELECT topic_cluster_id FROM mk_anomalies, cfg
    WHERE anomaly_type = 'cluster' AND detected_at >= now - 604800000)"""


def _clusters(v):
    return k.cluster_anomalies(v.anomalies, v.anomaly_markets, v.memberships, v.clusters, v.now, WEEK_MIN)


register(
    "cluster_anomalies",
    lambda v: _clusters(v).select("anomaly_type", "severity", "topic_cluster_id", "market_count", "direction"),
    CLUSTER_SQL,
    "severity",
)
register(
    "cluster_anomaly_links",
    lambda v: k.cluster_anomaly_links(
        _clusters(v), v.anomalies, v.anomaly_markets, v.memberships, v.now, WEEK_MIN
    ).drop("anomaly_id"),
    f"""WITH hit AS ({CLUSTER_SQL}), {PER_MARKET},
       newest AS (SELECT market_id, price_delta, volume_ratio FROM (SELECT l.*, row_number() OVER (
           PARTITION BY market_id ORDER BY detected_at DESC, a.id DESC) AS rn
         FROM mk_anomaly_markets l JOIN mk_anomalies a ON a.id = l.anomaly_id) WHERE rn = 1)
       SELECT m.market_id, n.price_delta, n.volume_ratio FROM mk_memberships m
         JOIN per ON per.market_id = m.market_id JOIN hit ON hit.topic_cluster_id = m.cluster_id
         LEFT JOIN newest n ON n.market_id = m.market_id""",
    "price_delta volume_ratio",
)
for _mode, _up, _down in (
    ("text", "summary LIKE '%+%'", "summary LIKE '%-%'"),
    ("delta", "price_delta > 0", "price_delta < 0"),
):
    register(
        f"anomaly_direction_{_mode}",
        lambda v, mode=_mode: v.anomaly_markets.join(
            v.anomalies.select(F.col("id").alias("anomaly_id"), "summary"), "anomaly_id"
        ).groupBy("market_id").agg(*k.sign_counts(mode)).select(
            "market_id", k.direction(F.col("ups"), F.col("downs")).alias("direction")
        ),
        f"""SELECT market_id, {_dir('u', 'd')} AS direction FROM (
             SELECT market_id, count(*) FILTER (WHERE {_up}) AS u, count(*) FILTER (WHERE {_down}) AS d
             FROM mk_anomaly_markets l JOIN mk_anomalies a ON a.id = l.anomaly_id GROUP BY 1)""",
    )

INDEX_SQL = """WITH mem AS (SELECT m.*, k.platform FROM mk_memberships m JOIN mk_markets k ON k.id = m.market_id WHERE is_active),
  side AS (SELECT cluster_id, platform, count(*) AS n, max(confidence) AS top FROM mem GROUP BY 1, 2)
  SELECT mem.cluster_id, c.name AS cluster_name, mem.platform, market_id, confidence,
    CAST(sum(side.n) AS BIGINT) AS partners, least(confidence, max(side.top)) AS best_confidence
  FROM mem JOIN side ON side.cluster_id = mem.cluster_id AND side.platform <> mem.platform
    JOIN mk_clusters c ON c.id = mem.cluster_id GROUP BY 1, 2, 3, 4, 5"""


def _index(v):
    return k.link_index(v.memberships, v.markets, v.clusters)


register("build_links", _index, INDEX_SQL, "confidence best_confidence")
register(
    "links_of_pairs",
    # asks for every stored pair: which of them are linked through a shared cluster, too
    lambda v: k.links_of_pairs(_index(v), v.links, v.now).select("market_id_a", "market_id_b", "confidence"),
    f"""WITH i AS ({INDEX_SQL}) SELECT l.market_id_a, l.market_id_b, least(a.confidence, b.confidence) AS confidence
        FROM mk_links l JOIN i a ON a.market_id = l.market_id_a
          JOIN i b ON b.market_id = l.market_id_b AND b.cluster_id = a.cluster_id""",
    "confidence",
)
register(
    "query_links",
    lambda v: k.query_links(v.links, 8).select("market_id_a", "market_id_b", "confidence"),
    "SELECT * FROM mk_links WHERE market_id_a = 8 OR market_id_b = 8 ORDER BY confidence DESC",
    "confidence",
)
register(
    "query_link_pair",
    lambda v: k.query_pair(v.links, 9, 8).select("market_id_a", "market_id_b", "confidence"),
    "SELECT * FROM mk_links WHERE market_id_a = 8 AND market_id_b = 9",
    "confidence",
)
register(
    "anomalous_partners",
    lambda v: k.anomalous_partners(v.anomalies, v.anomaly_markets, v.memberships, v.markets, v.now, WEEK_MIN),
    f"""WITH {PER_MARKET},
       mem AS (SELECT m.market_id, cluster_id, platform, sev FROM mk_memberships m
         JOIN mk_markets k ON k.id = m.market_id JOIN per USING (market_id) WHERE is_active),
       pr AS (SELECT a.market_id, b.market_id AS partner_id, b.sev FROM mem a JOIN mem b USING (cluster_id) WHERE a.platform <> b.platform)
       SELECT market_id, arg_max(partner_id, (sev, -partner_id)) AS partner_id, count(*) AS n_links FROM pr GROUP BY 1""",
)
register(
    "cross_platform_anomalies",
    lambda v: k.cross_platform_anomalies(
        v.anomalies, v.anomaly_markets, v.links, v.now, WEEK_MIN
    ).select("market_id_a", "market_id_b", "severity", "signal_type", "direction"),
    f"""WITH {PER_MARKET}, dd AS (SELECT market_id, sev, {_dir('ups', 'downs')} AS dir FROM per)
       SELECT market_id_a, market_id_b, CAST(printf('%.4f', CAST(least(1, (a.sev + b.sev) / 2 * 1.2) AS DOUBLE)) AS DOUBLE) AS severity,
         CASE WHEN a.dir = b.dir AND a.dir <> 'undetermined' THEN 'convergent'
           WHEN a.dir <> 'undetermined' AND b.dir <> 'undetermined' THEN 'divergent' ELSE 'undetermined' END AS signal_type,
         CASE WHEN a.dir = b.dir AND a.dir <> 'undetermined' THEN a.dir
           WHEN a.dir <> 'undetermined' AND b.dir <> 'undetermined' THEN 'mixed' ELSE 'undetermined' END AS direction
       FROM mk_links l JOIN dd a ON a.market_id = l.market_id_a JOIN dd b ON b.market_id = l.market_id_b""",
    "severity",
)

SERIES_MIN = 20 * DAY_MIN
MOVES_SQL = """p AS (SELECT market_id, max("timestamp") AS last_ts,
      count(*) FILTER (WHERE event_type = 'price_change' AND "timestamp" >= now - 1728000000) AS n,
      arg_min(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change' AND "timestamp" >= now - 1728000000) AS p0,
      arg_max(new_value, ("timestamp", id)) FILTER (WHERE event_type = 'price_change' AND "timestamp" >= now - 1728000000) AS p1
    FROM mk_events, cfg GROUP BY 1),
  mv AS (SELECT split_part(external_id, '-', 1) AS series_prefix, market_id, external_id,
      CASE WHEN n >= 2 AND p0 <> 0 THEN (p1 - p0) / p0 END AS change_pct
    FROM p JOIN mk_markets k ON k.id = p.market_id, cfg WHERE is_active AND last_ts >= now - 432000000)"""


def _moves(v):
    return k.series_moves(v.events, v.markets, v.now, v.now - 5 * DAY, SERIES_MIN)


def _with_tickers(found, moves):
    """The rows of the markets that moved, put together for the comparison."""
    rows = k.series_tickers(found, moves).join(moves.select("external_id", "market_id"), "external_id")
    named = rows.groupBy("anomaly_id").agg(F.sort_array(F.collect_list(F.struct("market_id", "external_id"))).alias("t"))
    return found.join(named, found["id"] == named["anomaly_id"], "left").select(
        "series_prefix", "direction", "movers", "total_markets", "avg_change_pct", "severity", "market_count",
        F.array_join("t.external_id", " ").alias("tickers"),
    )


register("series_moves", _moves, f"WITH {MOVES_SQL} SELECT * FROM mv", "change_pct")
register(
    "series_anomalies",
    lambda v: _with_tickers(k.series_anomalies(_moves(v), v.anomalies, v.now, SERIES_MIN, min_movers=2), _moves(v)),
    f"""WITH {MOVES_SQL},
       s AS (SELECT series_prefix, count(*) AS total_markets, count(*) FILTER (WHERE change_pct >= 0.03) AS un,
           count(*) FILTER (WHERE change_pct <= -0.03) AS dn, avg(change_pct) FILTER (WHERE change_pct >= 0.03) AS ua,
           avg(-change_pct) FILTER (WHERE change_pct <= -0.03) AS da FROM mv GROUP BY 1),
       q AS (SELECT series_prefix, total_markets, CASE WHEN un >= dn THEN 'up' ELSE 'down' END AS direction,
           CASE WHEN un >= dn THEN un ELSE dn END AS movers, CASE WHEN un >= dn THEN ua ELSE da END AS avg_change_pct FROM s),
       tk AS (SELECT series_prefix, direction, string_agg(external_id, ' ' ORDER BY market_id) AS tickers FROM (
           SELECT *, CASE WHEN change_pct > 0 THEN 'up' ELSE 'down' END AS direction,
             row_number() OVER (PARTITION BY series_prefix, change_pct > 0 ORDER BY market_id) AS rn
           FROM mv WHERE abs(change_pct) >= 0.03) GROUP BY 1, 2)
       SELECT q.series_prefix, q.direction, movers, total_markets, avg_change_pct, CAST(movers AS INTEGER) AS market_count, tickers,
         least(1, 0.5 * movers / total_markets + 0.5 * least(1, ln(1 + 100 * avg_change_pct) / 4)) AS severity
       FROM q LEFT JOIN tk USING (series_prefix, direction) WHERE movers >= 2 AND total_markets >= 2""",
    "avg_change_pct severity",
)
register(
    "series_links",
    lambda v: k.series_links(
        k.series_anomalies(_moves(v), v.anomalies, v.now, SERIES_MIN, min_movers=2), _moves(v)
    ).drop("anomaly_id", "volume_ratio"),
    f"""WITH {MOVES_SQL},
       s AS (SELECT series_prefix, count(*) FILTER (WHERE change_pct >= 0.03) AS un,
           count(*) FILTER (WHERE change_pct <= -0.03) AS dn FROM mv GROUP BY 1)
       SELECT market_id, change_pct AS price_delta FROM mv JOIN s USING (series_prefix)
       WHERE (un >= dn AND un >= 2 AND change_pct >= 0.03) OR (un < dn AND dn >= 2 AND change_pct <= -0.03)""",
    "price_delta",
)
register(
    "trending_topics",
    lambda v: k.trending_topics(v.clusters, v.memberships, v.anomaly_markets, v.anomalies),
    """SELECT c.id AS cluster_id, c.name, c.description, count(DISTINCT m.market_id) AS market_count,
         count(DISTINCT a.id) AS anomaly_count, max(a.severity) AS max_severity
       FROM mk_clusters c LEFT JOIN mk_memberships m ON m.cluster_id = c.id
         LEFT JOIN mk_anomaly_markets l ON l.market_id = m.market_id
         LEFT JOIN mk_anomalies a ON a.id = l.anomaly_id AND a.status = 'active' GROUP BY 1, 2, 3""",
    "max_severity",
)
