"""Single-market anomalies: rule scores, selection, lifecycle and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.keyed import apply_changes, hashed_id
from tidewatch.functions.text import fixed, percent, round_exact
from tidewatch.operators.windows import baseline_columns, trailing_samples


@dataclass(frozen=True)
class WindowRule:
    """Thresholds of one window size."""

    window_minutes: int
    price_change_threshold: float = fv.PRICE_CHANGE_THRESHOLD
    volume_spike_multiplier: float = fv.VOLUME_SPIKE_MULTIPLIER
    zscore_threshold: float = fv.ZSCORE_THRESHOLD


DEFAULT_RULES = tuple(WindowRule(w) for w in fv.WINDOW_MINUTES)


def _per_rule(rules: Sequence[WindowRule], field: str) -> Column:
    """The threshold of the row's window size."""
    out = None
    for r in rules:
        hit, value = F.col("window_minutes") == r.window_minutes, F.lit(float(getattr(r, field)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def price_score(pct: Column, threshold: Column) -> Column:
    """Logarithmic score of a relative price change above the threshold."""
    ratio = F.abs(pct) / threshold
    score = F.least(F.lit(1.0), F.log10(ratio + 1.0) / F.log10(F.lit(101.0)))
    return F.when(F.abs(pct) > threshold, score).otherwise(0.0)


def volume_score(total: Column, mean: Column, multiplier: Column) -> Column:
    """Score of a volume above ``multiplier`` times its baseline mean."""
    ratio = total / F.when(mean > 0, mean)
    hit = (total > 0) & (ratio > multiplier)
    return F.when(hit, F.least(F.lit(1.0), ratio / (multiplier * 2))).otherwise(0.0)


def zscore_score(pct: Column, mean: Column, stddev: Column, threshold: Column) -> Column:
    """Score of a price change far from its baseline in standard deviations."""
    z = F.abs(pct - mean) / F.when(stddev > 0, stddev)
    return F.when(z > threshold, F.least(F.lit(1.0), z / (threshold * 2))).otherwise(0.0)


def scored(stats: DataFrame, rules: Sequence[WindowRule] = DEFAULT_RULES) -> DataFrame:
    """Add the three rule scores and the severity to window statistics with baselines."""
    pct = F.col("price_change_pct")
    return stats.withColumns(
        {
            "price_score": price_score(pct, _per_rule(rules, "price_change_threshold")),
            "volume_score": volume_score(
                F.col("volume_total"),
                F.col("volume_mean"),
                _per_rule(rules, "volume_spike_multiplier"),
            ),
            "zscore_score": zscore_score(
                pct, F.col("pct_mean"), F.col("pct_stddev"), _per_rule(rules, "zscore_threshold")
            ),
        }
    ).withColumn(
        "severity",
        round_exact(F.greatest("price_score", "volume_score", "zscore_score"), 4),
    )


CURRENT_COLUMNS = (
    "window_start", "window_end", "price_start", "price_end", "price_delta", "price_change_pct",
    "volume_total", "trade_count", "event_count",
)


def window_scores(
    events: DataFrame,
    now_ms: int,
    rules: Sequence[WindowRule] = DEFAULT_RULES,
    baseline_hours: int = fv.BASELINE_HOURS,
) -> DataFrame:
    """Current statistics, baseline and rule scores of every (market, window) with events.

    Statistics and baseline come from the same samples in one aggregation; nothing is joined.
    """
    samples = trailing_samples(
        events, now_ms, [r.window_minutes for r in rules], baseline_hours
    )
    in_baseline, current = F.col("is_sample"), F.col("is_current")
    both = samples.groupBy("market_id", "window_minutes").agg(
        F.max(F.when(current, F.struct(*CURRENT_COLUMNS))).alias("now"),
        *baseline_columns("price_change_pct", in_baseline),
        *baseline_columns("volume", in_baseline),
    )
    stats = both.filter(F.col("now").isNotNull()).select(
        "market_id", "window_minutes", "now.*", "pct_mean", "pct_stddev", "pct_samples",
        "volume_mean", "volume_stddev", "volume_samples",
    )
    return scored(stats, rules)


def display_title(title: Column, market_id: Column) -> Column:
    """Title for summaries, whole; unknown markets show their id."""
    return F.coalesce(title, F.concat(F.lit("market_id="), market_id.cast("string")))


def detect_single(scores: DataFrame, markets: DataFrame) -> DataFrame:
    """One anomaly per (market, window) with positive severity, with its summary text."""
    hits = scores.filter("severity > 0")
    titles = markets.select(F.col("id").alias("market_id"), "title")
    start, end = F.col("price_start"), F.col("price_end")
    price_part = F.when(
        F.col("price_score") > 0,
        F.concat(
            percent(F.col("price_change_pct"), 1, signed=True),
            F.lit(" ("), percent(start), F.lit("→"), percent(end), F.lit(")"),
        ),
    )
    parts = F.concat_ws(
        ", ",
        price_part,
        F.when(F.col("volume_score") > 0, F.concat(fixed(F.col("volume_total")), F.lit(" vol"))),
        F.when(F.col("zscore_score") > 0, F.lit("z-score breach")),
    )
    ratio = F.when(
        (F.col("volume_total") > 0) & (F.col("volume_mean") > 0),
        round_exact(F.col("volume_total") / F.col("volume_mean"), 2),
    )
    return hits.join(titles, "market_id", "left").select(
        hashed_id(
            "single_market", F.col("market_id"), F.col("window_minutes"), F.col("window_end")
        ).alias("id"),
        "market_id",
        "window_minutes",
        F.lit("single_market").alias("anomaly_type"),
        "severity",
        "window_start",
        F.col("window_end").alias("detected_at"),
        F.concat(
            display_title(F.col("title"), F.col("market_id")),
            F.lit(": "), parts, F.lit(" in "), F.col("window_minutes"), F.lit("min window"),
        ).alias("summary"),
        "price_delta",
        ratio.alias("volume_ratio"),
    )


def strongest_per_market(found: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Highest severity of each market; of equals the window configured first."""
    position = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("window_minutes"))
    rest = [c for c in found.columns if c != "market_id"]
    return (
        found.groupBy("market_id")
        .agg(F.max_by(F.struct(*rest), F.struct("severity", -position)).alias("best"))
        .select("market_id", "best.*")
    )


def markets_with_active_anomalies(anomalies: DataFrame, links: DataFrame) -> DataFrame:
    active = anomalies.filter("status = 'active'").select(F.col("id").alias("anomaly_id"))
    return links.join(active, "anomaly_id", "left_semi").select("market_id").distinct()


def detect_new(
    found: DataFrame, anomalies: DataFrame, links: DataFrame, windows: Sequence[int]
) -> DataFrame:
    """Anomalies to store: best window per market, markets with an active anomaly left out."""
    busy = markets_with_active_anomalies(anomalies, links)
    return strongest_per_market(found.join(busy, "market_id", "left_anti"), windows)


def as_anomaly_rows(found: DataFrame) -> DataFrame:
    """Detected single-market rows in the shape of the anomalies table."""
    return found.select(
        "id",
        "anomaly_type",
        "severity",
        F.lit(None).cast("long").alias("topic_cluster_id"),
        F.lit(1).alias("market_count"),
        "window_start",
        "detected_at",
        "summary",
        F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("metadata"),
    )


def as_link_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("anomaly_id"), "market_id", "price_delta", "volume_ratio")


def expire_anomalies(anomalies: DataFrame, older_than_ms: int) -> DataFrame:
    """Active anomalies detected before the cutoff become expired."""
    old = (F.col("status") == "active") & (F.col("detected_at") < older_than_ms)
    return anomalies.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def query_anomalies(
    anomalies: DataFrame,
    links: DataFrame | None = None,
    since_ms: int | None = None,
    until_ms: int | None = None,
    status: str | None = None,
    anomaly_type: str | None = None,
    min_severity: float | None = None,
    market_id: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered anomalies, newest first; a limit cuts the list."""
    out = anomalies
    for column, value in (("status", status), ("anomaly_type", anomaly_type)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if since_ms is not None:
        out = out.filter(F.col("detected_at") >= since_ms)
    if until_ms is not None:
        out = out.filter(F.col("detected_at") <= until_ms)
    if min_severity is not None:
        out = out.filter(F.col("severity") >= min_severity)
    if market_id is not None:
        of_market = links.filter(F.col("market_id") == market_id).select(
            F.col("anomaly_id").alias("id")
        )
        out = out.join(of_market, "id", "left_semi")
    out = out.orderBy(F.col("detected_at").desc(), F.col("id").desc())
    return out if limit is None else out.limit(limit)


def anomaly_links(links: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Market rows of the given anomalies."""
    return links.join(
        anomalies.select(F.col("id").alias("anomaly_id")), "anomaly_id", "left_semi"
    )


def update_anomalies(anomalies: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, status?, metadata?) changes; NULL leaves a field as it is."""
    fields = [c for c in ("status", "metadata") if c in changes.columns]
    return apply_changes(anomalies, changes, ["id"], fields)


def active_anomalies_view(anomalies: DataFrame, clusters: DataFrame) -> DataFrame:
    names = clusters.select(F.col("id").alias("topic_cluster_id"), F.col("name").alias("cluster_name"))
    return (
        anomalies.filter("status = 'active'")
        .join(names, "topic_cluster_id", "left")
        .select(
            F.col("id").alias("anomaly_id"), "anomaly_type", "severity", "market_count",
            "detected_at", "summary", "metadata", "cluster_name",
        )
    )


def severity_counts() -> list[Column]:
    s = F.col("severity")
    return [
        F.count_if(s >= fv.SEVERITY_HIGH).alias("high"),
        F.count_if((s >= fv.SEVERITY_MEDIUM) & (s < fv.SEVERITY_HIGH)).alias("medium"),
        F.count_if(s < fv.SEVERITY_MEDIUM).alias("low"),
    ]


def anomaly_stats(anomalies: DataFrame) -> DataFrame:
    """Count, mean severity and severity buckets; zeros for an empty table."""
    return anomalies.agg(
        F.count("*").alias("active_count"),
        F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"),
        *severity_counts(),
    )


def severity_label(severity: Column) -> Column:
    return (
        F.when(severity >= fv.SEVERITY_HIGH, "High")
        .when(severity >= fv.SEVERITY_MEDIUM, "Medium")
        .otherwise("Low")
    )


def with_labels(anomalies: DataFrame) -> DataFrame:
    """Display labels of severity and anomaly type."""
    kind = F.col("anomaly_type")
    label = description = None
    for name, (short, text) in fv.ANOMALY_TYPE_LABELS.items():
        label = F.when(kind == name, short) if label is None else label.when(kind == name, short)
        description = (
            F.when(kind == name, text) if description is None else description.when(kind == name, text)
        )
    return anomalies.withColumns(
        {
            "severity_label": severity_label(F.col("severity")),
            "type_label": label.otherwise(F.replace(kind, F.lit("_"), F.lit(" "))),
            "type_description": description.otherwise(fv.UNKNOWN_ANOMALY_DESCRIPTION),
        }
    )


def alert_rate_report(anomalies: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """Alert volume of the trailing hours against the daily limit."""
    days = max(hours / 24, 1)
    return (
        anomalies.filter(F.col("detected_at") >= now_ms - hours * 3_600_000)
        .agg(F.count("*").alias("total"), *severity_counts())
        .withColumn("per_day", F.col("total") / F.lit(float(days)))
        .withColumn(
            "gate", F.when(F.col("per_day") < fv.MAX_ALERTS_PER_DAY, "PASS").otherwise("HIGH")
        )
    )


def signal_report(anomalies: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Single-market versus cluster alert rates of the trailing days."""
    kind, per = F.col("anomaly_type"), F.lit(float(max(days, 1)))
    return (
        anomalies.filter(F.col("detected_at") >= now_ms - days * 86_400_000)
        .agg(
            F.count("*").alias("total"),
            F.count_if(kind == "single_market").alias("single_market"),
            F.count_if(kind == "cluster").alias("cluster"),
            *severity_counts(),
        )
        .withColumns(
            {"per_day": F.col("total") / per, "cluster_per_day": F.col("cluster") / per}
        )
        .withColumn(
            "gate", F.when(F.col("per_day") < fv.MAX_ALERTS_PER_DAY, "PASS").otherwise("FAIL")
        )
    )


def cluster_signal_detail(anomalies: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Cluster anomalies of the trailing days with the name and direction they carry."""
    doc = F.from_json("metadata", "cluster_name string, direction string")
    return anomalies.filter(
        (F.col("anomaly_type") == "cluster")
        & (F.col("detected_at") >= now_ms - days * 86_400_000)
    ).select(
        F.col("id").alias("anomaly_id"),
        "detected_at",
        F.coalesce(doc["cluster_name"], F.lit("")).alias("cluster_name"),
        "market_count",
        F.coalesce(doc["direction"], F.lit("")).alias("direction"),
        "severity",
    )
