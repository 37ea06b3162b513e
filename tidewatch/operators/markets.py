"""The market dimension: upserts, state changes, lookups and serving views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.keyed import (
    apply_changes,
    hashed_id,
    merge_keyed,
    previous_by_chunk,
    top_k_per_key,
)
from tidewatch.functions.text import iso_millis

NATURAL_KEY = ["platform", "external_id"]


def upsert_markets(current: DataFrame, snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Merge discovery snapshots into the dimension (overwrite-in-place attributes).

    Known markets keep id, first_seen_at and prices; the newest snapshot of a market wins.
    """
    attrs = ["title", "description", "category", "end_date", "is_active", "volume"]
    newest = snapshots.groupBy(*NATURAL_KEY).agg(
        F.max_by(F.struct(*attrs), F.struct("snapshot_ts", *attrs)).alias("s")
    )
    incoming = newest.select(
        *NATURAL_KEY,
        "s.*",
        hashed_id("market", *[F.col(c) for c in NATURAL_KEY]).alias("new_id"),
    )
    seen = F.col("inc.new_id").isNotNull()

    def attr(name: str) -> Column:
        return F.when(seen, F.col(f"inc.{name}")).otherwise(F.col(f"cur.{name}"))

    merged = merge_keyed(
        current,
        incoming,
        NATURAL_KEY,
        {
            "id": F.coalesce("cur.id", "inc.new_id"),
            **{a: attr(a) for a in attrs},
            "first_seen_at": F.coalesce("cur.first_seen_at", F.lit(now_ms)),
            "last_updated_at": F.when(seen, F.lit(now_ms)).otherwise(F.col("cur.last_updated_at")),
            "yes_price": F.col("cur.yes_price"),
            "price_updated_at": F.col("cur.price_updated_at"),
        },
    )
    return merged.select(*current.columns)


def count_new(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """How many markets an upsert of ``snapshots`` would create (one row: new_markets)."""
    fresh = snapshots.select(*NATURAL_KEY).distinct()
    return fresh.join(current.select(*NATURAL_KEY), NATURAL_KEY, "left_anti").agg(
        F.count("*").alias("new_markets")
    )


def lookup_markets(markets: DataFrame, keys: DataFrame) -> DataFrame:
    """Markets named by a table of keys: (platform, external_id) or (id)."""
    on = NATURAL_KEY if set(NATURAL_KEY) <= set(keys.columns) else ["id"]
    return markets.join(keys.select(*on), on, "left_semi")


def active_markets(markets: DataFrame, platform: str | None = None) -> DataFrame:
    out = markets.filter("is_active")
    return out if platform is None else out.filter(F.col("platform") == platform)


def _deactivate(markets: DataFrame, condition: Column) -> DataFrame:
    off = F.col("is_active") & F.coalesce(condition, F.lit(False))
    return markets.withColumn("is_active", F.col("is_active") & ~off)


def deactivate_stale(markets: DataFrame, platform: str, before_ms: int) -> DataFrame:
    """Active markets of a platform not refreshed since ``before_ms`` become inactive."""
    return _deactivate(
        markets, (F.col("platform") == platform) & (F.col("last_updated_at") < before_ms)
    )


def deactivate_expired(markets: DataFrame, now_ms: int) -> DataFrame:
    """Markets past their end date become inactive; unreadable dates are left alone."""
    return _deactivate(markets, iso_millis(F.col("end_date")) <= now_ms)


def terminal_market_ids(events: DataFrame) -> DataFrame:
    """Markets with a status_change to a terminal status (group lifecycle rows do not count)."""
    changes = events.filter(F.col("event_type") == "status_change").select("market_id", "metadata")
    return (
        with_parsed(changes, "metadata", "status string, source string", "d")
        .filter(
            F.lower("d.status").isin(*fv.TERMINAL_STATUSES)
            & ~F.coalesce(F.col("d.source") == "event_lifecycle_v2", F.lit(False))
        )
        .select("market_id")
        .distinct()
    )


def deactivate_terminal(markets: DataFrame, events: DataFrame) -> DataFrame:
    ended = terminal_market_ids(events).select(
        F.col("market_id").alias("id"), F.lit(False).alias("is_active")
    )
    return apply_changes(markets, ended, ["id"], ["is_active"])


def newest_prices(events: DataFrame) -> DataFrame:
    """Newest price_change of each market; of equal timestamps the first event counts."""
    return (
        events.filter(F.col("event_type") == "price_change")
        .groupBy(F.col("market_id").alias("id"))
        .agg(
            F.max_by("new_value", F.struct("timestamp", -F.col("id"))).alias("yes_price"),
            F.max("timestamp").alias("price_updated_at"),
        )
    )


def apply_latest_prices(markets: DataFrame, events: DataFrame) -> DataFrame:
    """Set yes_price where an event is strictly newer than the stored price."""
    prices = newest_prices(events).withColumn("ended", F.lit(False))
    return fold_market_changes(markets, prices)


def market_changes(events: DataFrame) -> DataFrame:
    """What a batch of events changes in the dimension: (id, yes_price, price_updated_at, ended)."""
    ended = terminal_market_ids(events).select(
        F.col("market_id").alias("id"), F.lit(True).alias("ended")
    )
    return newest_prices(events).join(ended, "id", "full_outer").withColumn(
        "ended", F.coalesce("ended", F.lit(False))
    )


def fold_market_changes(markets: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply the changes of any number of batches; applying them again alters nothing."""
    folded = changes.groupBy("id").agg(
        F.max_by("yes_price", F.col("price_updated_at")).alias("__price"),
        F.max("price_updated_at").alias("__ts"),
        F.bool_or("ended").alias("__ended"),
    )
    newer = F.col("__ts").isNotNull() & (
        F.col("price_updated_at").isNull() | (F.col("__ts") > F.col("price_updated_at"))
    )
    return (
        markets.join(folded, "id", "left")
        .withColumns(
            {
                "yes_price": F.when(newer, F.col("__price")).otherwise(F.col("yes_price")),
                "price_updated_at": F.when(newer, F.col("__ts")).otherwise(F.col("price_updated_at")),
                "is_active": F.col("is_active") & ~F.coalesce("__ended", F.lit(False)),
            }
        )
        .select(*markets.columns)
    )


def series_markets(markets: DataFrame, prefix: str) -> DataFrame:
    return markets.filter(
        F.col("is_active") & F.col("external_id").startswith(f"{prefix}-")
    ).orderBy("external_id")


def tracked_universe(markets: DataFrame, limit: int | None = None) -> DataFrame:
    """Active markets; with a limit the most recently refreshed ones (a top-k report)."""
    active = markets.filter("is_active")
    if limit is None:
        return active
    return active.orderBy(F.col("last_updated_at").desc(), F.col("id")).limit(limit)


def universe_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """external_id with change 'added' or 'removed'; one shuffle for both directions."""
    sides = current.select("external_id", F.lit(1).alias("side")).unionByName(
        previous.select("external_id", F.lit(2).alias("side"))
    )
    return (
        sides.groupBy("external_id")
        .agg(F.bit_or("side").alias("sides"))
        .filter("sides < 3")
        .select(
            "external_id",
            F.when(F.col("sides") == 1, "added").otherwise("removed").alias("change"),
        )
    )


def recently_active_markets(events: DataFrame, since_ms: int) -> DataFrame:
    return events.filter(F.col("timestamp") >= since_ms).select("market_id").distinct()


def price_steps(snapshots: DataFrame, markets: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """Snapshots of known active markets with the price before (``last_price``; ``has_last_price`` is false for the first)."""
    known = markets.filter("is_active").select(*NATURAL_KEY, F.col("id").alias("market_id"))
    return previous_by_chunk(
        snapshots.join(known, NATURAL_KEY, "inner"),
        ["market_id"], "snapshot_ts", "external_id", "yes_price", chunk_ms, "last_price",
    )


def discovery_change_events(
    snapshots: DataFrame, markets: DataFrame, chunk_ms: int = 86_400_000
) -> DataFrame:
    """Events implied by successive listing snapshots of known active markets.

    First price of a market (or first after an empty one): new_market plus a first_seen
    price_change. Later a price_change whenever the price differs from the previous snapshot.
    """
    return price_change_events(price_steps(snapshots, markets, chunk_ms))


def price_change_events(steps: DataFrame) -> DataFrame:
    """The events of snapshots that know the price before them."""
    price, last = F.col("yes_price"), F.col("last_price")
    title_doc = F.to_json(F.struct("title", "category"), {"ignoreNullFields": "false"})

    def event(kind: str, old: Column, metadata: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), old.alias("old_value"), metadata.alias("metadata")
        )

    no_price = F.lit(None).cast("double")
    first_seen = F.array(
        event("new_market", no_price, title_doc),
        event("price_change", no_price, F.lit('{"source": "first_seen"}')),
    )
    moved = F.array(event("price_change", last, F.lit(None).cast("string")))
    emitted = F.when(last.isNull(), first_seen).when(price != last, moved)
    return (
        steps.filter(price.isNotNull())
        .select("market_id", "snapshot_ts", "yes_price", F.explode(emitted).alias("e"))
        .select(
            "market_id",
            "e.event_type",
            "e.old_value",
            F.col("yes_price").alias("new_value"),
            "e.metadata",
            F.col("snapshot_ts").alias("timestamp"),
        )
    )


def discovery_seed_events(snapshots: DataFrame, markets: DataFrame, now_ms: int) -> DataFrame:
    """First cycle of a platform: one price_change per known active market with a price."""
    known = markets.filter("is_active").select(*NATURAL_KEY, F.col("id").alias("market_id"))
    return (
        snapshots.filter(F.col("yes_price").isNotNull())
        .join(known, NATURAL_KEY, "inner")
        .select(
            "market_id",
            F.lit("price_change").alias("event_type"),
            F.lit(None).cast("double").alias("old_value"),
            F.col("yes_price").alias("new_value"),
            F.to_json(F.struct(F.lit("discovery_seed").alias("source"), "title")).alias("metadata"),
            F.lit(now_ms).cast("long").alias("timestamp"),
        )
    )


def rank_score(now_ms: int) -> Column:
    """0.4 volume + 0.3 price recency + 0.3 closeness of the end date, each in [0, 1]."""
    volume, price_ts, end_ms = F.col("volume"), F.col("price_updated_at"), iso_millis(F.col("end_date"))
    by_volume = F.when(volume > 0, F.least(F.log(volume + 1) / 10.0, F.lit(1.0)))
    hours = (F.lit(now_ms) - price_ts) / 3_600_000.0
    days = (end_ms - F.lit(now_ms)) / 86_400_000.0
    by_price = F.least(1.0 / F.greatest(hours, F.lit(0.1)), F.lit(1.0))
    by_end = F.when(end_ms > now_ms, F.least(1.0 / F.greatest(days, F.lit(0.01)), F.lit(1.0)))
    zero = F.lit(0.0)
    return (
        F.coalesce(by_volume, zero) * 0.4
        + F.when(price_ts.isNotNull(), by_price).otherwise(zero) * 0.3
        + F.coalesce(by_end, zero) * 0.3
    )


def current_market_state(markets: DataFrame, now_ms: int) -> DataFrame:
    """Serving view: active priced markets with their rank score."""
    return markets.filter(F.col("is_active") & F.col("yes_price").isNotNull()).select(
        F.col("id").alias("market_id"),
        "platform",
        "external_id",
        "title",
        "description",
        "category",
        "end_date",
        "is_active",
        F.col("yes_price").alias("last_price"),
        F.col("price_updated_at").alias("last_price_ts"),
        F.lit(None).cast("double").alias("last_volume"),
        F.lit(None).cast("long").alias("last_volume_ts"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        rank_score(now_ms).alias("rank_score"),
    )


def market_summaries(markets: DataFrame, events: DataFrame, with_events_only: bool = False) -> DataFrame:
    """Event count and first/last event time per market; events are reduced before the join."""
    per_market = events.groupBy("market_id").agg(
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("first_event_ts"),
        F.max("timestamp").alias("last_event_ts"),
    )
    base = markets.select(F.col("id").alias("market_id"), "platform", "title", "category")
    how = "inner" if with_events_only else "left"
    return base.join(per_market, "market_id", how).withColumn(
        "event_count", F.coalesce("event_count", F.lit(0).cast("long"))
    )


def market_search(
    state: DataFrame,
    platform: str | None = None,
    search: str | None = None,
    sort: str = "rank_score",
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """The market list in order, or the page that is asked for."""
    column = {"rank_score": "rank_score", "price": "last_price", "volume": "volume"}[sort]
    out = state
    if platform:
        out = out.filter(F.col("platform") == platform)
    if search:
        out = out.filter(F.lower("title").contains(search.lower()))
    ordered = out.orderBy(F.coalesce(F.col(column), F.lit(0.0)).desc(), F.col("market_id"))
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def _stat(stat: str, name: Column, n: Column) -> Column:
    return F.struct(F.lit(stat).alias("stat"), name.alias("name"), n.alias("n"))


def market_stats(markets: DataFrame) -> DataFrame:
    """Long form: (stat, name, n) for total, active, platform and non-empty category counts."""
    counts = markets.groupBy("platform", "category").agg(
        F.count("*").alias("n"), F.count_if("is_active").alias("active")
    )
    cells = F.array(
        _stat("total", F.lit(""), F.col("n")),
        _stat("active", F.lit(""), F.col("active")),
        _stat("platform", F.col("platform"), F.col("n")),
        _stat("category", F.coalesce("category", F.lit("")), F.col("n")),
    )
    return (
        counts.select(F.explode(cells).alias("c"))
        .select("c.*")
        .filter("stat <> 'category' or name <> ''")
        .groupBy("stat", "name")
        .agg(F.sum("n").alias("n"))
    )


def event_group_top_outcomes(markets: DataFrame, top: int = 10) -> DataFrame:
    """Markets grouped by ticker prefix: size, group title and the top outcomes by volume."""
    keyed = markets.withColumn("event_key", F.substring_index("external_id", "-", 1))
    groups = keyed.groupBy("event_key").agg(
        F.count("*").alias("group_size"),
        F.coalesce(
            F.min_by("description", F.when(F.col("description") != "", F.col("id"))), F.lit("")
        ).alias("group_title"),
    )
    best = top_k_per_key(
        keyed.select("event_key", "id", "external_id", "volume"),
        ["event_key"],
        [F.coalesce("volume", F.lit(0.0)).desc(), F.col("id")],
        top,
        spread_by=["id"],
        rank_col="outcome_rank",
    )
    return best.join(groups, "event_key").select(
        "event_key", "group_size", "group_title", "outcome_rank",
        F.col("id").alias("market_id"), "external_id", "volume",
    )


def purge_orphans(markets: DataFrame, events: DataFrame) -> DataFrame:
    """Drop inactive markets without any event."""
    with_events = events.select(F.col("market_id").alias("id")).distinct()
    flagged = markets.join(with_events.withColumn("__used", F.lit(True)), "id", "left")
    return flagged.filter(F.col("is_active") | F.col("__used").isNotNull()).select(*markets.columns)
