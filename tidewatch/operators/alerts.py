"""Per-user alerts: preference matching, hourly throttle and the alert inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.keyed import apply_changes, merge_keyed, top_k_per_key

MAX_PER_HOUR = 10
HOUR_MS = 3_600_000
ANY = "\u0001any"


def new_anomalies(feed: DataFrame, seen: DataFrame) -> DataFrame:
    """Feed rows whose anomaly_id was not processed before."""
    return feed.filter("anomaly_id is not null").join(seen.select("anomaly_id"), "anomaly_id", "left_anti")


def alertable_users(users: DataFrame) -> DataFrame:
    """Users with alerts switched on; missing preference lists are empty."""
    nothing = F.array().cast("array<string>")
    return users.filter("alerts_enabled").select(
        "user_id",
        F.coalesce("categories", nothing).alias("categories"),
        F.coalesce("platforms", nothing).alias("platforms"),
    )


def labelled(feed: DataFrame) -> DataFrame:
    """Lower-case ``category`` (cluster name, else catalyst type) and ``platform``; '' if none."""
    cluster = F.nullif(F.trim(F.coalesce("cluster_name", F.lit(""))), F.lit(""))
    kind = F.col("catalyst_type") if "catalyst_type" in feed.columns else F.lit(None).cast("string")
    platform = F.col("platform") if "platform" in feed.columns else F.lit("")
    return feed.withColumns(
        {
            "category": F.lower(F.coalesce(cluster, kind, F.lit(""))),
            "platform": F.lower(F.coalesce(platform, F.lit(""))),
        }
    )


def _wanted_keys(preferences: Column) -> Column:
    """Keys a user accepts: everything, or the listed values and unlabelled anomalies."""
    listed = F.array_distinct(F.concat(F.transform(preferences, F.lower), F.array(F.lit(""))))
    return F.when(F.size(preferences) == 0, F.array(F.lit(ANY))).otherwise(listed)


def _user_keys(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id",
        F.explode(_wanted_keys(F.col("categories"))).alias("cat_key"),
        "platforms",
    ).select("user_id", "cat_key", F.explode(_wanted_keys(F.col("platforms"))).alias("plat_key"))


def _anomaly_keys(labelled_feed: DataFrame) -> DataFrame:
    """Each anomaly under its own labels and under ANY for either test."""
    return labelled_feed.withColumn(
        "cat_key", F.explode(F.array(F.col("category"), F.lit(ANY)))
    ).withColumn("plat_key", F.explode(F.array(F.col("platform"), F.lit(ANY))))


def match_counts(labelled_feed: DataFrame, users: DataFrame) -> DataFrame:
    """How many anomalies match each user's preferences, and the strongest of them.

    Anomalies are reduced to one row per label pair before users are joined, so the work does
    not grow with users x anomalies.
    """
    per_key = _anomaly_keys(labelled_feed).groupBy("cat_key", "plat_key").agg(
        F.count("*").alias("n"), F.max("severity").alias("top")
    )
    return (
        _user_keys(users)
        .join(per_key, ["cat_key", "plat_key"], "left")
        .groupBy("user_id")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"),
            F.max("top").alias("max_severity"),
        )
    )


def matched_and_throttled(
    labelled_feed: DataFrame,
    users: DataFrame,
    sent: DataFrame,
    now_ms: int,
    per_hour: int = MAX_PER_HOUR,
) -> DataFrame:
    """The (user, anomaly) pairs to alert, newest anomalies first, at most ``per_hour`` a user.

    A user's accepted label pairs are disjoint sets of anomalies, and at most ``per_hour`` of
    each set can be used. So the first ``per_hour`` anomalies of every label pair are enough:
    the join sees that short list instead of every anomaly, and the result is exact.
    """
    order = [F.col("detected_at").desc(), F.col("anomaly_id").desc()]
    shortlist = top_k_per_key(
        _anomaly_keys(labelled_feed), ["cat_key", "plat_key"], order, per_hour,
        spread_by=["anomaly_id"],
    )
    used = (
        sent.filter(F.col("created_at") > now_ms - HOUR_MS)
        .groupBy("user_id")
        .agg(F.count("*").alias("used"))
    )
    in_feed_order = Window.partitionBy("user_id").orderBy(*order)
    return (
        _user_keys(users)
        .join(shortlist, ["cat_key", "plat_key"])
        .withColumn("seq", F.row_number().over(in_feed_order))
        .filter(F.col("seq") <= per_hour)
        .join(used, "user_id", "left")
        .filter(F.col("seq") <= per_hour - F.coalesce("used", F.lit(0).cast("long")))
        .drop("cat_key", "plat_key", "used")
    )


def create_alerts(matched: DataFrame, now_ms: int) -> DataFrame:
    """Alert rows: headline of the catalyst, else the summary; unread."""
    headline = F.col("headline") if "headline" in matched.columns else F.lit(None).cast("string")
    return matched.select(
        "user_id",
        F.lit("anomaly").alias("type"),
        F.coalesce(headline, "summary", F.lit("Anomaly detected")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("message"),
        "anomaly_id",
        F.lit(None).cast("long").alias("market_id"),
        F.lit(False).alias("is_read"),
        F.lit(now_ms).cast("long").alias("created_at"),
    )


def unread_count(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def user_alerts(alerts: DataFrame, per_user: int | None = None) -> DataFrame:
    """Each user's alerts; with ``per_user`` only so many of the newest."""
    if per_user is None:
        return alerts
    return top_k_per_key(
        alerts, ["user_id"], [F.col("created_at").desc(), F.col("anomaly_id").desc()], per_user,
        spread_by=["anomaly_id"],
    )


def mark_read(alerts: DataFrame, read: DataFrame) -> DataFrame:
    """Mark (user_id, anomaly_id) alerts as read; rows of other users are untouched."""
    changes = read.select("user_id", "anomaly_id").distinct().withColumn("is_read", F.lit(True))
    return apply_changes(alerts, changes, ["user_id", "anomaly_id"], ["is_read"])


def update_preferences(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge given preference fields over current or default ones."""
    nothing = F.array().cast("array<string>")
    defaults = {
        "categories": nothing,
        "platforms": nothing,
        "alerts_enabled": F.lit(True),
        "email_notifications": F.lit(False),
    }
    merged = merge_keyed(
        users,
        changes,
        ["user_id"],
        {
            "known": F.col("cur.user_id").isNotNull(),
            "touched": F.col("inc.user_id").isNotNull(),
            **{
                f: F.when(
                    F.col("inc.user_id").isNotNull(),
                    F.coalesce(F.col(f"inc.{f}"), F.col(f"cur.{f}"), d),
                ).otherwise(F.col(f"cur.{f}"))
                for f, d in defaults.items()
            },
        },
    )
    return merged.filter("known").select(*users.columns)
