"""One detection cycle over all recently active markets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import fixed_values as fv
from tidewatch.operators import catalyst, correlation, detection, markets, narrative, quality
from tidewatch.session import settle


@dataclass(frozen=True)
class Tables:
    """The stored tables a cycle reads."""

    events: DataFrame
    markets: DataFrame
    anomalies: DataFrame
    anomaly_markets: DataFrame
    clusters: DataFrame
    memberships: DataFrame
    links: DataFrame
    asked: DataFrame | None = None  # pairs (market_id_a, market_id_b) beside those of best partners, linked if a cluster has both


@dataclass(frozen=True)
class CycleConfig:
    rules: Sequence[detection.WindowRule] = detection.DEFAULT_RULES
    baseline_hours: int = fv.BASELINE_HOURS
    expiry_hours: int = fv.ANOMALY_EXPIRY_HOURS
    recent_ms: int = 600_000
    correlation_minutes: int = fv.CORRELATION_WINDOW_MINUTES
    series_minutes: int = fv.CORRELATION_WINDOW_MINUTES
    min_cluster_markets: int = fv.CLUSTER_MIN_MARKETS
    direction_mode: str = "text"
    retention_days: int = 0


@dataclass(frozen=True)
class CycleResult:
    anomalies: DataFrame  # all anomalies after the cycle
    anomaly_markets: DataFrame  # all link rows after the cycle
    new_anomalies: DataFrame  # rows added by this cycle
    events: DataFrame  # the log after retention
    stages: dict[str, DataFrame] = field(default_factory=dict)


def _rows(df: DataFrame) -> DataFrame:
    return schemas.conform(df, schemas.ANOMALIES)


def _links(df: DataFrame) -> DataFrame:
    return schemas.conform(df, schemas.ANOMALY_MARKETS)


def detection_cycle(t: Tables, now_ms: int, config: CycleConfig = CycleConfig()) -> CycleResult:
    """Expire, detect, attribute, correlate over clusters, series and platforms, retain.

    There is no cap on markets. What several later steps read (the new anomalies and their
    links, a tiny share of the input) is written once to the checkpoint folder, so the log is
    not scanned again for each of them and a lost executor costs a re-read, not a re-run.
    """
    stored = _rows(
        detection.expire_anomalies(t.anomalies, now_ms - config.expiry_hours * 3_600_000)
    )
    stored_links = _links(t.anomaly_markets)
    upto = t.events.filter(F.col("timestamp") <= now_ms)
    since = now_ms - config.recent_ms
    windows = [r.window_minutes for r in config.rules]

    recent = markets.recently_active_markets(upto, since)
    scores = detection.window_scores(upto, now_ms, config.rules, config.baseline_hours)
    found = detection.detect_single(
        scores.filter("severity > 0").join(recent, "market_id", "left_semi"), t.markets
    )
    fresh = settle(detection.detect_new(found, stored, stored_links, windows))
    named = fresh.withColumn("anomaly_id", F.col("id"))
    metadata = catalyst.ANOMALY_KEYS
    # no new anomaly began longer ago than the longest window, so no more of the log is read
    lately = quality.since(upto, now_ms - max(windows) * 60_000)
    singles = _rows(
        detection.as_anomaly_rows(fresh).drop("metadata").join(
            narrative.catalyst_metadata(named.select(*metadata), lately, t.markets), "id", "left"
        )
    )
    singles = settle(singles)
    single_links = _links(detection.as_link_rows(fresh))
    after = stored.unionByName(singles)
    after_links = stored_links.unionByName(single_links)

    clusters = correlation.cluster_anomalies(
        after, after_links, t.memberships, t.clusters, now_ms, config.correlation_minutes,
        config.min_cluster_markets, config.direction_mode,
    )
    clusters = settle(clusters)
    cluster_links = correlation.cluster_anomaly_links(
        clusters, after, after_links, t.memberships, now_ms, config.correlation_minutes
    )
    after_clusters = after.unionByName(_rows(clusters))

    moves = settle(
        correlation.series_moves(upto, t.markets, now_ms, since, config.series_minutes)
    )
    series = settle(
        correlation.series_anomalies(
            moves, after_clusters, now_ms, config.series_minutes,
            max(fv.SERIES_MIN_MOVERS, config.min_cluster_markets),
        )
    )
    series_links = correlation.series_links(series, moves)

    # links are refreshed from the clusters: stored pairs, asked pairs, and each anomalous member with its best partner
    pairs = t.links.select("market_id_a", "market_id_b", "confidence")
    wanted = correlation.anomalous_partners(
        after_clusters, after_links, t.memberships, t.markets, now_ms, config.correlation_minutes
    ).select(F.col("market_id").alias("market_id_a"), F.col("partner_id").alias("market_id_b"))
    if t.asked is not None:
        wanted = wanted.unionByName(t.asked.select("market_id_a", "market_id_b"))
    index = correlation.link_index(t.memberships, t.markets, t.clusters)
    linked = correlation.links_of_pairs(index, wanted, now_ms).select(pairs.columns)
    pairs = pairs.unionByName(linked.join(t.links, ["market_id_a", "market_id_b"], "left_anti"))
    crossed = settle(
        correlation.cross_platform_anomalies(
            after_clusters, after_links, pairs, now_ms, config.correlation_minutes,
            config.direction_mode,
        )
    )

    new_rows = (
        singles.unionByName(_rows(clusters)).unionByName(_rows(series)).unionByName(_rows(crossed))
    )
    new_links = (
        single_links.unionByName(_links(cluster_links))
        .unionByName(_links(series_links))
        .unionByName(_links(correlation.pair_links(crossed)))
    )
    cutoff = quality.retention_cutoff(now_ms, config.retention_days)
    return CycleResult(
        anomalies=stored.unionByName(new_rows),
        anomaly_markets=stored_links.unionByName(new_links),
        new_anomalies=new_rows,
        events=t.events if cutoff is None else quality.prune_events(t.events, cutoff),
        stages={"single": singles, "cluster": clusters, "series": series, "cross_platform": crossed},
    )


def cycle_counts(result: CycleResult) -> DataFrame:
    """(stage, found, mean_severity) of a cycle."""
    out = None
    for name, df in result.stages.items():
        row = df.agg(
            F.count("*").alias("found"), F.round(F.avg("severity"), 6).alias("mean_severity")
        ).withColumn("stage", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("stage", "found", "mean_severity")
