"""Alert queries."""

from pyspark.sql import functions as F

from tidewatch.operators import alerts as a
from workload.registry import register

HOUR = 3_600_000


def _labelled(v):
    return a.labelled(v.feed)


def _users(v):
    return a.alertable_users(v.users)


def _recent_alerts(v):
    """Sent alerts moved so that a month of them falls into three hours."""
    return v.alerts.withColumn(
        "created_at", F.lit(v.now) - F.floor((F.lit(v.now) - F.col("created_at")) / F.lit(240)).cast("long")
    )


MATCH = """mt AS (SELECT u.user_id, f.* FROM mk_users u JOIN mk_feed f ON
    (len(u.categories) = 0 OR f.cluster_name IS NULL OR list_contains(u.categories, lower(f.cluster_name)))
    AND (len(u.platforms) = 0 OR list_contains(u.platforms, f.platform)) WHERE u.alerts_enabled)"""
THROTTLE = f"""{MATCH},
  used AS (SELECT user_id, count(*) AS used FROM (SELECT user_id, now - (now - created_at) // 240 AS ts FROM mk_alerts, cfg), cfg
    WHERE ts > now - 3600000 GROUP BY 1),
  th AS (SELECT * FROM (SELECT mt.*, row_number() OVER (PARTITION BY mt.user_id ORDER BY detected_at DESC, anomaly_id DESC) AS seq FROM mt)
    LEFT JOIN used USING (user_id) WHERE seq <= 10 - coalesce(used, 0))"""

register(
    "new_anomalies",
    lambda v: a.new_anomalies(v.feed, v.alerts).select("anomaly_id"),
    "SELECT anomaly_id FROM mk_feed WHERE anomaly_id NOT IN (SELECT anomaly_id FROM mk_alerts)",
)
register(
    "match_preferences",
    lambda v: a.match_counts(_labelled(v), _users(v)),
    f"""WITH {MATCH} SELECT u.user_id, count(mt.anomaly_id) AS matches, max(mt.severity) AS max_severity
        FROM mk_users u LEFT JOIN mt USING (user_id) WHERE u.alerts_enabled GROUP BY 1""",
    "max_severity",
)
register(
    "throttle_alerts",
    lambda v: a.matched_and_throttled(_labelled(v), _users(v), _recent_alerts(v), v.now).select(
        "user_id", "anomaly_id", "seq"
    ),
    f"WITH {THROTTLE} SELECT user_id, anomaly_id, CAST(seq AS INTEGER) AS seq FROM th",
)
register(
    "create_alerts",
    lambda v: a.create_alerts(
        a.matched_and_throttled(_labelled(v), _users(v), _recent_alerts(v), v.now), v.now
    ).drop("market_id"),
    f"""WITH {THROTTLE} SELECT user_id, 'anomaly' AS "type", summary AS title, summary AS message, anomaly_id,
         false AS is_read, now AS created_at FROM th, cfg""",
)
register(
    "alertable_users",
    lambda v: _users(v).select("user_id", F.size("categories").alias("categories"), F.size("platforms").alias("platforms")),
    """SELECT user_id, CASE WHEN n % 6 = 5 THEN 0 WHEN n % 4 = 0 THEN 2 ELSE 1 END AS categories,
         CAST(len(platforms) AS INTEGER) AS platforms
       FROM (SELECT *, CAST(substr(user_id, 2) AS BIGINT) AS n FROM mk_users) WHERE alerts_enabled""",
)
register(
    "unread_count",
    lambda v: a.unread_count(v.alerts),
    "SELECT user_id, count(*) FILTER (WHERE NOT is_read) AS unread FROM mk_alerts GROUP BY 1",
)
register(
    "user_alerts",
    lambda v: a.user_alerts(v.alerts, 5).select("user_id", "anomaly_id", "created_at"),
    """SELECT user_id, anomaly_id, created_at FROM (SELECT *, row_number() OVER (
         PARTITION BY user_id ORDER BY created_at DESC, anomaly_id DESC) AS rn FROM mk_alerts) WHERE rn <= 5""",
)
register(
    "mark_read",
    # U1 asks to read every alert: only its own change
    lambda v: a.mark_read(
        v.alerts, v.alerts.select(F.lit("U1").alias("user_id"), "anomaly_id")
    ).select("user_id", "anomaly_id", "is_read"),
    "SELECT user_id, anomaly_id, is_read OR user_id = 'U1' AS is_read FROM mk_alerts",
)
register(
    "update_preferences",
    lambda v: a.update_preferences(
        v.users,
        v.table("supplier").filter("s_acctbal < 0").selectExpr(
            "concat('U', s_suppkey) as user_id", "array('x') as categories",
            "cast(null as array<string>) as platforms", "true as alerts_enabled",
            "cast(null as boolean) as email_notifications",
        ),
    ).select("user_id", F.array_join("categories", ",").alias("categories"),
             F.size(F.coalesce("platforms", F.array())).alias("platforms"), "alerts_enabled", "email_notifications"),
    """SELECT u.user_id, CASE WHEN s_acctbal < 0 THEN 'x' WHEN s_suppkey % 6 = 5 THEN ''
         WHEN s_suppkey % 4 = 0 THEN (['HOUSEHOLD','Machinery','FURNITURE','building','AUTOMOBILE'])[s_suppkey % 6 + 1] || ',automobile'
         ELSE (['HOUSEHOLD','Machinery','FURNITURE','building','AUTOMOBILE'])[s_suppkey % 6 + 1] END AS categories,
         CAST(len(platforms) AS INTEGER) AS platforms, alerts_enabled OR s_acctbal < 0 AS alerts_enabled, false AS email_notifications
       FROM mk_users u JOIN supplier ON u.user_id = 'U' || s_suppkey""",
)
