"""Anomalies across topic clusters, ticker series and linked markets of different platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.keyed import earliest, hashed_id, latest
from tidewatch.functions.text import fixed, mean_exact, percent, round_exact, series_prefix

MINUTE_MS = 60_000


def sign_counts(mode: str = "text") -> list[Column]:
    """Aggregates ``ups`` and ``downs`` over anomalies.

    ``text`` looks for the word "price" and a sign in the summary, as stored summaries are
    judged; ``delta`` uses the sign of the link's price_delta.
    """
    if mode == "delta":
        up, down = F.col("price_delta") > 0, F.col("price_delta") < 0
    else:
        about_price = F.lower("summary").contains("price")
        up = about_price & F.col("summary").contains("+")
        down = about_price & ~F.col("summary").contains("+") & F.col("summary").contains("-")
    return [F.count_if(up).alias("ups"), F.count_if(down).alias("downs")]


def direction(ups: Column, downs: Column) -> Column:
    return (
        F.when((ups > 0) & (downs == 0), "bullish")
        .when((downs > 0) & (ups == 0), "bearish")
        .when((ups > 0) & (downs > 0), "mixed")
        .otherwise("undetermined")
    )


def recent_single_by_market(
    anomalies: DataFrame, links: DataFrame, now_ms: int, window_minutes: int, mode: str = "text"
) -> DataFrame:
    """Active single-market anomalies of the window, reduced to one row per market."""
    recent = anomalies.filter(
        (F.col("anomaly_type") == "single_market")
        & (F.col("status") == "active")
        & (F.col("detected_at") >= now_ms - window_minutes * MINUTE_MS)
    ).select(F.col("id").alias("anomaly_id"), "severity", "summary")
    return (
        links.select("anomaly_id", "market_id", "price_delta")
        .join(recent, "anomaly_id", "inner")
        .groupBy("market_id")
        .agg(F.max("severity").alias("max_severity"), *sign_counts(mode))
    )


def _emitted_in_window(anomalies: DataFrame, kind: str, now_ms: int, minutes: int) -> DataFrame:
    return anomalies.filter(
        (F.col("anomaly_type") == kind)
        & (F.col("detected_at") >= now_ms - minutes * MINUTE_MS)
    )


def cluster_anomalies(
    anomalies: DataFrame,
    links: DataFrame,
    memberships: DataFrame,
    clusters: DataFrame,
    now_ms: int,
    window_minutes: int = fv.CORRELATION_WINDOW_MINUTES,
    min_markets: int = fv.CLUSTER_MIN_MARKETS,
    mode: str = "text",
) -> DataFrame:
    """Clusters in which several markets are anomalous at once.

    Every step is a partial aggregation; affected markets stay rows (see
    :func:`cluster_anomaly_links`), they are not collected.
    """
    per_market = recent_single_by_market(anomalies, links, now_ms, window_minutes, mode)
    emitted = (
        _emitted_in_window(anomalies, "cluster", now_ms, window_minutes)
        .select(F.col("topic_cluster_id").alias("cluster_id"))
        .filter("cluster_id is not null")
        .distinct()
    )
    per_cluster = (
        memberships.select("market_id", "cluster_id")
        .join(per_market, "market_id", "inner")
        .groupBy("cluster_id")
        .agg(
            F.count("*").cast("int").alias("market_count"),
            mean_exact(F.col("max_severity"), 4).alias("severity"),
            F.sum("ups").alias("ups"),
            F.sum("downs").alias("downs"),
        )
        .filter(F.col("market_count") >= min_markets)
        .join(emitted, "cluster_id", "left_anti")
    )
    named = per_cluster.join(
        clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id", "inner"
    ).withColumn("direction", direction(F.col("ups"), F.col("downs")))
    return named.select(
        hashed_id("cluster", F.col("cluster_id"), F.lit(now_ms)).alias("id"),
        F.lit("cluster").alias("anomaly_type"),
        "severity",
        F.col("cluster_id").alias("topic_cluster_id"),
        "market_count",
        F.lit(now_ms - window_minutes * MINUTE_MS).alias("window_start"),
        F.lit(now_ms).alias("detected_at"),
        F.concat(
            F.lit("["), F.col("name"), F.lit("] "), F.col("market_count"), F.lit(" markets "),
            F.col("direction"), F.lit(": cluster anomaly (severity "),
            fixed(F.col("severity"), 2), F.lit(")"),
        ).alias("summary"),
        F.lit("active").alias("status"),
        F.to_json(F.struct(F.col("name").alias("cluster_name"), "direction")).alias("metadata"),
        "direction",
    )


def cluster_anomaly_links(
    found: DataFrame, anomalies: DataFrame, links: DataFrame, memberships: DataFrame,
    now_ms: int, window_minutes: int = fv.CORRELATION_WINDOW_MINUTES,
) -> DataFrame:
    """Link rows of cluster anomalies: each affected market with the values of its most recent
    single-market anomaly (of any status)."""
    affected = recent_single_by_market(anomalies, links, now_ms, window_minutes).select("market_id")
    singles = anomalies.filter("anomaly_type = 'single_market'").select(
        F.col("id").alias("anomaly_id"), "detected_at"
    )
    newest = (
        links.join(singles, "anomaly_id", "inner")
        .groupBy("market_id")
        .agg(
            latest(
                F.struct("price_delta", "volume_ratio"), F.col("detected_at"), F.col("anomaly_id")
            ).alias("v")
        )
    )
    hit = found.select(F.col("id").alias("anomaly_id"), F.col("topic_cluster_id").alias("cluster_id"))
    return (
        memberships.select("market_id", "cluster_id")
        .join(affected, "market_id", "left_semi")
        .join(hit, "cluster_id", "inner")
        .join(newest, "market_id", "left")
        .select("anomaly_id", "market_id", "v.price_delta", "v.volume_ratio")
    )


def link_index(memberships: DataFrame, markets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cross-platform links in factored form: one row per (cluster, active member).

    Every member is linked with every member of the cluster on another platform, so the pairs
    follow from this table and are expanded only where they are asked for
    (:func:`links_of_pairs`). ``partners`` is how many links the member
    has in the cluster and ``best_confidence`` the highest confidence among them (the smaller
    of the two memberships' confidences).
    """
    members = memberships.select("market_id", "cluster_id", "confidence").join(
        markets.filter("is_active").select(F.col("id").alias("market_id"), "platform"), "market_id"
    )
    per_side = members.groupBy("cluster_id", "platform").agg(
        F.count("*").alias("n"), F.max("confidence").alias("top")
    )
    other = per_side.select(
        "cluster_id", F.col("platform").alias("other"), F.col("n").alias("other_n"),
        F.col("top").alias("other_top"),
    )
    # a few platforms per cluster: this self-join has (clusters x platforms^2) rows
    facing = (
        per_side.join(other, "cluster_id")
        .filter("platform <> other")
        .groupBy("cluster_id", "platform")
        .agg(F.sum("other_n").alias("partners"), F.max("other_top").alias("facing_top"))
    )
    names = clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"))
    return (
        members.join(facing, ["cluster_id", "platform"], "inner")
        .join(names, "cluster_id", "inner")
        .select(
            "cluster_id", "cluster_name", "platform", "market_id", "confidence", "partners",
            F.least("confidence", "facing_top").alias("best_confidence"),
        )
    )


def links_of_pairs(index: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """The links among the asked-for market pairs (market_id_a, market_id_b, either order)."""
    wanted = pairs.select(
        F.least("market_id_a", "market_id_b").alias("market_id_a"),
        F.greatest("market_id_a", "market_id_b").alias("market_id_b"),
    ).distinct()
    side = index.select("cluster_id", "cluster_name", "platform", "market_id", "confidence")
    a = side.select(*[F.col(c).alias(f"{c}_a") if c != "cluster_id" else F.col(c) for c in side.columns])
    b = side.select(*[F.col(c).alias(f"{c}_b") if c != "cluster_id" else F.col(c) for c in side.columns])
    both = (
        wanted.join(a, "market_id_a")
        .join(b, ["market_id_b", "cluster_id"])
        .filter("platform_a <> platform_b")
    )
    return both.groupBy("market_id_a", "market_id_b").agg(
        F.max_by(
            F.least("confidence_a", "confidence_b"), F.struct("cluster_name_a", "cluster_id")
        ).alias("confidence")
    ).select(
        "market_id_a", "market_id_b", "confidence", F.lit("cluster").alias("method"),
        F.lit(now_ms).cast("long").alias("created_at"),
    )


def anomalous_partners(
    anomalies: DataFrame, links: DataFrame, memberships: DataFrame, markets: DataFrame, now_ms: int,
    window_minutes: int = fv.CORRELATION_WINDOW_MINUTES,
) -> DataFrame:
    """Links among the anomalous markets of clusters in factored form: (market_id, partner_id, n_links).

    An active member that is anomalous in the window is linked with every such member of its
    clusters on another platform. The pairs grow with the square of a cluster, so each member gets
    one row: its best partner (highest severity, then smallest id) and how many links it has,
    counted per cluster. A side of a cluster is reduced to its size and its best member first.
    """
    per_market = recent_single_by_market(anomalies, links, now_ms, window_minutes).select("market_id", "max_severity")
    members = (
        memberships.select("market_id", "cluster_id")
        .distinct()
        .join(per_market, "market_id")
        .join(markets.filter("is_active").select(F.col("id").alias("market_id"), "platform"), "market_id")
    )
    rank = F.struct("max_severity", (-F.col("market_id")).alias("minus_id"))
    per_side = members.groupBy("cluster_id", "platform").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
    other = per_side.select("cluster_id", F.col("platform").alias("other"), F.col("n").alias("other_n"), F.col("best").alias("other_best"))
    # a few platforms per cluster: this self-join has (clusters x platforms^2) rows
    facing = (
        per_side.join(other, "cluster_id")
        .filter("platform <> other")
        .groupBy("cluster_id", "platform")
        .agg(F.sum("other_n").alias("other_n"), F.max("other_best").alias("other_best"))
    )
    return (
        members.join(facing, ["cluster_id", "platform"])
        .groupBy("market_id")
        .agg(F.sum("other_n").alias("n_links"), F.max("other_best").alias("best"))
        .select("market_id", (-F.col("best.minus_id")).alias("partner_id"), "n_links")
    )


def query_links(links: DataFrame, market_id: int) -> DataFrame:
    """Stored links touching a market, most confident first."""
    return links.filter(
        (F.col("market_id_a") == market_id) | (F.col("market_id_b") == market_id)
    ).orderBy(F.col("confidence").desc(), "market_id_a", "market_id_b")


def query_pair(links: DataFrame, one: int, other: int) -> DataFrame:
    low, high = min(one, other), max(one, other)
    return links.filter((F.col("market_id_a") == low) & (F.col("market_id_b") == high))


def cross_platform_anomalies(
    anomalies: DataFrame,
    links: DataFrame,
    pairs: DataFrame,
    now_ms: int,
    window_minutes: int = fv.CORRELATION_WINDOW_MINUTES,
    mode: str = "text",
) -> DataFrame:
    """Linked ``pairs`` whose two markets are anomalous in the window."""
    per_market = recent_single_by_market(anomalies, links, now_ms, window_minutes, mode).select(
        "market_id", "max_severity", direction(F.col("ups"), F.col("downs")).alias("direction")
    )

    def side(s: str) -> DataFrame:
        return per_market.select(
            F.col("market_id").alias(f"market_id_{s}"),
            F.col("max_severity").alias(f"severity_{s}"),
            F.col("direction").alias(f"direction_{s}"),
        )

    emitted = (
        with_parsed(
            _emitted_in_window(anomalies, "cross_platform", now_ms, window_minutes),
            "metadata", "market_id_a long, market_id_b long", "d",
        )
        .filter("d.market_id_a is not null and d.market_id_b is not null")
        .select(
            F.least("d.market_id_a", "d.market_id_b").alias("market_id_a"),
            F.greatest("d.market_id_a", "d.market_id_b").alias("market_id_b"),
        )
        .distinct()
    )
    known_a = F.col("direction_a") != "undetermined"
    known_b = F.col("direction_b") != "undetermined"
    same = F.col("direction_a") == F.col("direction_b")
    signal = (
        F.when(same & known_a, "convergent")
        .when(known_a & known_b, "divergent")
        .otherwise("undetermined")
    )
    together = (
        F.when(same & known_a, F.col("direction_a"))
        .when(known_a & known_b, "mixed")
        .otherwise("undetermined")
    )
    boosted = F.least(
        F.lit(1.0),
        (F.col("severity_a") + F.col("severity_b")) / 2.0 * fv.CROSS_PLATFORM_BOOST,
    )
    hits = (
        pairs.select("market_id_a", "market_id_b", F.col("confidence").alias("link_confidence"))
        .join(side("a"), "market_id_a")
        .join(side("b"), "market_id_b")
        .join(emitted, ["market_id_a", "market_id_b"], "left_anti")
        .withColumns({"signal_type": signal, "direction": together, "boosted": boosted})
    )
    return hits.select(
        hashed_id("cross_platform", F.col("market_id_a"), F.col("market_id_b"), F.lit(now_ms)).alias("id"),
        F.lit("cross_platform").alias("anomaly_type"),
        round_exact(F.col("boosted"), 4).alias("severity"),
        F.lit(None).cast("long").alias("topic_cluster_id"),
        F.lit(2).alias("market_count"),
        F.lit(now_ms - window_minutes * MINUTE_MS).alias("window_start"),
        F.lit(now_ms).alias("detected_at"),
        F.concat(
            F.lit("Cross-platform "), F.col("signal_type"), F.lit(": markets "),
            F.col("market_id_a"), F.lit(" & "), F.col("market_id_b"), F.lit(" ("),
            F.col("direction"), F.lit(", severity "), fixed(F.col("boosted"), 2), F.lit(")"),
        ).alias("summary"),
        F.lit("active").alias("status"),
        F.to_json(
            F.struct(
                "market_id_a", "market_id_b", "link_confidence", "signal_type", "direction",
                round_exact(F.col("severity_a"), 4).alias("severity_a"),
                round_exact(F.col("severity_b"), 4).alias("severity_b"),
            )
        ).alias("metadata"),
        "market_id_a",
        "market_id_b",
        "signal_type",
        "direction",
    )


def pair_links(found: DataFrame) -> DataFrame:
    """Link rows of cross-platform anomalies (both markets, no values)."""
    nothing = F.lit(None).cast("double")
    return found.select(
        F.col("id").alias("anomaly_id"),
        F.explode(F.array("market_id_a", "market_id_b")).alias("market_id"),
        nothing.alias("price_delta"),
        nothing.alias("volume_ratio"),
    )


def series_moves(
    events: DataFrame,
    markets: DataFrame,
    now_ms: int,
    recent_since_ms: int,
    window_minutes: int = fv.SERIES_WINDOW_MINUTES,
) -> DataFrame:
    """Recently active, active markets with a ticker prefix and their change in the window.

    Activity and price change come from one pass over the trailing events.
    """
    start = now_ms - window_minutes * MINUTE_MS
    price = (F.col("event_type") == "price_change") & F.col("timestamp").between(start, now_ms)
    value, ts, tie = F.col("new_value"), F.col("timestamp"), F.col("id")
    per_market = (
        events.filter(F.col("timestamp") >= min(start, recent_since_ms))
        .groupBy("market_id")
        .agg(
            F.max("timestamp").alias("last_ts"),
            F.count_if(price).alias("prices"),
            earliest(value, ts, tie, price).alias("first_price"),
            latest(value, ts, tie, price).alias("last_price"),
        )
        .filter(F.col("last_ts") >= recent_since_ms)
    )
    dim = markets.filter("is_active").select(
        F.col("id").alias("market_id"), "external_id",
        series_prefix(F.col("external_id")).alias("series_prefix"),
    ).filter("series_prefix <> ''")
    change = (F.col("last_price") - F.col("first_price")) / F.col("first_price")
    usable = (F.col("prices") >= 2) & (F.col("first_price") != 0)
    return per_market.join(dim, "market_id").select(
        "series_prefix", "market_id", "external_id", F.when(usable, change).alias("change_pct")
    )


def series_anomalies(
    moves: DataFrame,
    anomalies: DataFrame,
    now_ms: int,
    window_minutes: int = fv.SERIES_WINDOW_MINUTES,
    min_movers: int = fv.SERIES_MIN_MOVERS,
    threshold: float = fv.SERIES_PRICE_THRESHOLD,
) -> DataFrame:
    """Series in which enough markets moved the same way; severity is not rounded.

    The markets that moved are rows (:func:`series_links`, :func:`series_tickers`), not a list in a text.
    """
    change = F.col("change_pct")
    up, down = change >= threshold, change <= -threshold
    per_series = moves.groupBy("series_prefix").agg(
        F.count("*").alias("total_markets"),
        F.count_if(up).alias("up_n"),
        F.count_if(down).alias("down_n"),
        F.avg(F.when(up, change)).alias("up_avg"),
        F.avg(F.when(down, -change)).alias("down_avg"),
    )
    rising = F.col("up_n") >= F.col("down_n")
    picked = per_series.select(
        "series_prefix",
        "total_markets",
        F.when(rising, "up").otherwise("down").alias("direction"),
        F.when(rising, F.col("up_n")).otherwise(F.col("down_n")).alias("movers"),
        F.when(rising, F.col("up_avg")).otherwise(F.col("down_avg")).alias("avg_change_pct"),
    ).filter((F.col("movers") >= min_movers) & (F.col("total_markets") >= min_movers))
    emitted = (
        with_parsed(
            _emitted_in_window(anomalies, "cluster", now_ms, window_minutes),
            "metadata", "source string, series_prefix string", "d",
        )
        .filter("d.source = 'series_pattern' and d.series_prefix is not null")
        .select("d.series_prefix")
        .distinct()
    )
    fresh = picked.join(emitted, "series_prefix", "left_anti")
    avg, movers, total = F.col("avg_change_pct"), F.col("movers"), F.col("total_markets")
    severity = F.least(
        F.lit(1.0),
        movers / total * 0.5 + F.least(F.lit(1.0), F.log1p(avg * 100) / 4.0) * 0.5,
    )
    return fresh.select(
        hashed_id("series", F.col("series_prefix"), F.lit(now_ms)).alias("id"),
        F.lit("cluster").alias("anomaly_type"),
        severity.alias("severity"),
        F.lit(None).cast("long").alias("topic_cluster_id"),
        movers.cast("int").alias("market_count"),
        F.lit(now_ms - window_minutes * MINUTE_MS).alias("window_start"),
        F.lit(now_ms).alias("detected_at"),
        F.concat(
            F.lit("Series "), F.col("series_prefix"), F.lit(": "), movers, F.lit("/"), total,
            F.lit(" markets moved "), F.col("direction"), F.lit(" by avg "), percent(avg, 1),
            F.lit(f" in {window_minutes}min"),
        ).alias("summary"),
        F.lit("active").alias("status"),
        F.to_json(
            F.struct(
                F.lit("series_pattern").alias("source"), "series_prefix", "direction", "movers",
                "total_markets", round_exact(avg, 4).alias("avg_change_pct"),
            )
        ).alias("metadata"),
        "series_prefix",
        "direction",
        "movers",
        "total_markets",
        "avg_change_pct",
    )


def series_movers(moves: DataFrame, threshold: float = fv.SERIES_PRICE_THRESHOLD) -> DataFrame:
    change = F.col("change_pct")
    way = F.when(change >= threshold, "up").when(change <= -threshold, "down")
    return moves.withColumn("direction", way).filter("direction is not null")


def series_links(
    found: DataFrame, moves: DataFrame, threshold: float = fv.SERIES_PRICE_THRESHOLD
) -> DataFrame:
    """Link rows of series anomalies; price_delta holds the relative change."""
    hit = found.select(F.col("id").alias("anomaly_id"), "series_prefix", "direction")
    return series_movers(moves, threshold).join(hit, ["series_prefix", "direction"]).select(
        "anomaly_id",
        "market_id",
        F.col("change_pct").alias("price_delta"),
        F.lit(None).cast("double").alias("volume_ratio"),
    )


def series_tickers(
    found: DataFrame, moves: DataFrame, threshold: float = fv.SERIES_PRICE_THRESHOLD
) -> DataFrame:
    """(anomaly_id, external_id) of the markets that moved with a series anomaly."""
    hit = found.select(F.col("id").alias("anomaly_id"), "series_prefix", "direction")
    return series_movers(moves, threshold).join(hit, ["series_prefix", "direction"]).select("anomaly_id", "external_id")


def trending_topics(
    clusters: DataFrame, memberships: DataFrame, links: DataFrame, anomalies: DataFrame
) -> DataFrame:
    """Per cluster: markets, active anomalies of those markets and the highest severity."""
    sizes = memberships.groupBy("cluster_id").agg(
        F.countDistinct("market_id").alias("market_count")
    )
    active = anomalies.filter("status = 'active'").select(F.col("id").alias("anomaly_id"), "severity")
    hits = (
        memberships.select("cluster_id", "market_id")
        .join(links.select("market_id", "anomaly_id").join(active, "anomaly_id"), "market_id")
        .groupBy("cluster_id")
        .agg(
            F.countDistinct("anomaly_id").alias("anomaly_count"),
            F.max("severity").alias("max_severity"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        clusters.select(F.col("id").alias("cluster_id"), "name", "description")
        .join(sizes, "cluster_id", "left")
        .join(hits, "cluster_id", "left")
        .select(
            "cluster_id", "name", "description",
            F.coalesce("market_count", zero).alias("market_count"),
            F.coalesce("anomaly_count", zero).alias("anomaly_count"),
            "max_severity",
        )
    )
