"""Event log queries, integrity checks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.keyed import latest, top_k_per_key, with_totals

_RUN = 4096  # rows per stitched window: bounds what one task sorts


def in_range(since_ms: int | None, until_ms: int | None) -> Column:
    ts, cond = F.col("timestamp"), F.lit(True)
    if since_ms is not None:
        cond = cond & (ts >= since_ms)
    if until_ms is not None:
        cond = cond & (ts <= until_ms)
    return cond


def since(events: DataFrame, since_ms: int) -> DataFrame:
    """Events from a time on; a log that is partitioned by date also skips the earlier folders."""
    out = events.filter(F.col("timestamp") >= since_ms)
    if "event_date" in events.columns:
        out = out.filter(F.col("event_date") >= F.to_date(F.timestamp_millis(F.lit(since_ms))))
    return out


def get_events(
    events: DataFrame,
    market_id: int | None = None,
    event_type: str | None = None,
    since_ms: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Matching events, newest first; a limit cuts the list."""
    out = events.filter(in_range(since_ms, None))
    if market_id is not None:
        out = out.filter(F.col("market_id") == market_id)
    if event_type is not None:
        out = out.filter(F.col("event_type") == event_type)
    out = out.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return out if limit is None else out.limit(limit)


def events_in_window(
    events: DataFrame, event_type: str, start_ms: int, end_ms: int, market_id: int | None = None
) -> DataFrame:
    """Events of one type with start <= ts <= end, for one market or all."""
    out = events.filter(
        (F.col("event_type") == event_type) & F.col("timestamp").between(start_ms, end_ms)
    )
    return out if market_id is None else out.filter(F.col("market_id") == market_id)


def store_counts(
    markets: DataFrame, events: DataFrame, since_ms: int, until_ms: int
) -> DataFrame:
    per_events = events.agg(
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.count_if(F.col("timestamp").between(since_ms, until_ms)).alias("in_range"),
    )
    market_count = markets.agg(F.count("*").alias("market_count"))
    return with_totals(market_count, per_events)


def duplicate_events(
    events: DataFrame, since_ms: int | None = None, until_ms: int | None = None
) -> DataFrame:
    """Surplus copies over groups equal in (market, type, timestamp, value)."""
    groups = (
        events.filter(in_range(since_ms, until_ms))
        .groupBy("market_id", "event_type", "timestamp", "new_value")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def event_gaps(
    events: DataFrame,
    threshold_ms: int = 300_000,
    since_ms: int | None = None,
    until_ms: int | None = None,
) -> DataFrame:
    """Silences of at least ``threshold_ms`` in the whole log: (start_ts, end_ts, duration_ms).

    Two events in one bucket of threshold width are closer than the threshold, so every gap
    runs from the last event of one non-empty bucket to the first event of the next. The log is
    reduced to (min, max) per bucket map-side; only that summary is ordered, in runs of fixed
    size whose ends are stitched, so no task ever sorts more than a few thousand rows.
    """
    buckets = (
        events.filter(in_range(since_ms, until_ms))
        .groupBy(F.floor(F.col("timestamp") / F.lit(threshold_ms)).cast("long").alias("pos"))
        .agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    )
    pairs = _adjacent_gaps(buckets, levels=3)
    return pairs.filter(F.col("duration_ms") >= threshold_ms)


def _adjacent_gaps(spans: DataFrame, levels: int) -> DataFrame:
    """(start_ts, end_ts, duration_ms) between each span (pos, first_ts, last_ts) and the next."""
    if levels == 0:
        order = Window.orderBy("pos")
    else:
        spans = spans.withColumn("run", F.floor(F.col("pos") / F.lit(_RUN)).cast("long"))
        order = Window.partitionBy("run").orderBy("pos")
    inside = spans.withColumn("end_ts", F.lead("first_ts").over(order)).select(
        F.col("last_ts").alias("start_ts"),
        "end_ts",
        (F.col("end_ts") - F.col("last_ts")).alias("duration_ms"),
    ).filter(F.col("end_ts").isNotNull())
    if levels == 0:
        return inside
    runs = spans.groupBy(F.col("run").alias("pos")).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    return inside.unionByName(_adjacent_gaps(runs, levels - 1))


def ordering_violations(
    events: DataFrame, since_ms: int | None = None, until_ms: int | None = None
) -> DataFrame:
    """Events whose timestamp is before that of the event with the preceding id.

    Neighbours are compared inside blocks of consecutive ids; the last row of a block is also
    sent to the next one, so one shuffle finds every pair and a block has at most 4097 rows.
    """
    block = F.floor(F.col("id") / F.lit(_RUN)).cast("long")
    is_last = F.pmod(F.col("id"), F.lit(_RUN)) == _RUN - 1
    homes = F.when(is_last, F.array(block, block + 1)).otherwise(F.array(block))
    rows = events.select("id", "timestamp", F.explode(homes).alias("block"))
    by_id = Window.partitionBy("block").orderBy("id")
    pairs = rows.select(
        "id",
        "timestamp",
        "block",
        F.lag("id").over(by_id).alias("prev_id"),
        F.lag("timestamp").over(by_id).alias("prev_ts"),
    )
    bad = pairs.filter(
        (F.col("prev_id") == F.col("id") - 1)
        & (F.col("timestamp") < F.col("prev_ts"))
        & in_range(since_ms, until_ms)
    )
    return bad.agg(F.count("*").alias("violations"))


def event_type_distribution(
    events: DataFrame, since_ms: int | None = None, until_ms: int | None = None
) -> DataFrame:
    return (
        events.filter(in_range(since_ms, until_ms))
        .groupBy("event_type")
        .agg(F.count("*").alias("event_count"))
    )


def prune_events(events: DataFrame, older_than_ms: int) -> DataFrame:
    """The rows that stay. On a date-partitioned log whole days drop and one day is rewritten."""
    return events.filter(F.col("timestamp") >= older_than_ms)


def prune_preview(events: DataFrame, older_than_ms: int) -> DataFrame:
    return events.filter(F.col("timestamp") < older_than_ms).agg(F.count("*").alias("would_prune"))


def retention_cutoff(now_ms: int, retention_days: int) -> int | None:
    """Oldest timestamp kept; None when retention is off (0 days)."""
    return now_ms - retention_days * 86_400_000 if retention_days > 0 else None


def age_histogram(events: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Events per type, younger and older than ``days``: what a purge by type would touch."""
    young = F.col("timestamp") >= now_ms - days * 86_400_000
    return (
        events.groupBy("event_type", F.when(young, "recent").otherwise("old").alias("age"))
        .agg(F.count("*").alias("event_count"))
    )


def purge_by_type(
    events: DataFrame, event_type: str, older_than_ms: int | None = None
) -> DataFrame:
    """The log without one event type, or without its rows before a time."""
    doomed = F.col("event_type") == event_type
    if older_than_ms is not None:
        doomed = doomed & (F.col("timestamp") < older_than_ms)
    return events.filter(~doomed)


def integrity_report(
    events: DataFrame,
    gap_ms: int = 300_000,
    since_ms: int | None = None,
    min_events: int = 100_000,
    min_hours: float = 72.0,
) -> DataFrame:
    """(check_name, value, status) rows plus the overall gate."""
    totals = events.agg(
        F.count("*").cast("double").alias("total_events"),
        ((F.max("timestamp") - F.min("timestamp")) / 3_600_000.0).alias("duration_hours"),
    )
    long_enough = F.coalesce(F.col("duration_hours") >= min_hours, F.lit(False))
    enough = F.col("total_events") >= min_events

    def verdict(ok: Column, good: str = "PASS", bad: str = "WARN") -> Column:
        return F.when(ok, good).otherwise(bad)

    def check(name: str, value: Column, status: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check_name"), value.alias("value"), status.alias("status")
        )

    both = enough & long_enough
    cells = F.array(
        check("total_events", F.col("total_events"), verdict(enough)),
        check("duration_hours", F.col("duration_hours"), verdict(long_enough)),
        check("gate", both.cast("double"), verdict(both, bad="NOT MET")),
    )
    head = totals.select(F.explode(cells).alias("c")).select("c.*")

    def counted(df: DataFrame, name: str, column: str) -> DataFrame:
        value = F.col(column).cast("double")
        return df.select(F.lit(name).alias("check_name"), value.alias("value"),
                         verdict(value == 0).alias("status"))

    gaps = event_gaps(events, gap_ms, since_ms).agg(F.count("*").alias("n"))
    return (
        head.unionByName(counted(duplicate_events(events, since_ms), "duplicate_events", "duplicates"))
        .unionByName(counted(gaps, "gaps", "n"))
        .unionByName(
            counted(ordering_violations(events, since_ms), "ordering_violations", "violations")
        )
    )


def store_stats_report(markets: DataFrame, events: DataFrame) -> DataFrame:
    """(stat, name, value): market and event totals, time span and counts per type."""
    by_type = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    totals = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(stat).alias("stat"), F.lit("").alias("name"), F.col(c).alias("value"))
            for stat, c in (("events", "n"), ("first_ts", "lo"), ("last_ts", "hi"))
        ]
    )
    return (
        totals.select(F.explode(cells).alias("c"))
        .select("c.*")
        .unionByName(by_type.select(F.lit("event_type").alias("stat"),
                                    F.col("event_type").alias("name"), F.col("n").alias("value")))
        .unionByName(
            markets.agg(F.count("*").alias("value")).select(
                F.lit("markets").alias("stat"), F.lit("").alias("name"), "value"
            )
        )
    )


def recent_buffer(
    events: DataFrame,
    now_ms: int,
    max_age_ms: int = 86_400_000,
    per_market: int | None = None,
    event_type: str | None = None,
    since_ms: int | None = None,
) -> DataFrame:
    """Each market's events of the trailing day; with ``per_market`` only so many of the newest."""
    fresh = events.filter(F.col("timestamp").between(now_ms - max_age_ms, now_ms))
    kept = fresh
    if per_market is not None:
        kept = top_k_per_key(
            fresh,
            ["market_id"],
            [F.col("timestamp").desc(), F.col("id").desc()],
            per_market,
            spread_by=["id"],
        )
    if event_type is not None:
        kept = kept.filter(F.col("event_type") == event_type)
    return kept.filter(in_range(since_ms, None))


def latest_event(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Newest event of every market."""
    src = events if event_type is None else events.filter(F.col("event_type") == event_type)
    rest = [c for c in events.columns if c != "market_id"]
    return (
        src.groupBy("market_id")
        .agg(latest(F.struct(*rest), F.col("timestamp"), F.col("id")).alias("e"))
        .select("market_id", "e.*")
    )


def buffer_stats(buffer: DataFrame, now_ms: int) -> DataFrame:
    per_market = buffer.groupBy("market_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    return per_market.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_events"),
        F.count("*").alias("markets"),
        (F.lit(now_ms) - F.min("lo")).alias("oldest_age_ms"),
        (F.lit(now_ms) - F.max("hi")).alias("newest_age_ms"),
        F.max("n").alias("largest_market"),
    )
