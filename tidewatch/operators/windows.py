"""Trailing-window statistics and historical baselines for every market at once.

The log is read once and reduced to *panes*: half-open slices whose width divides every window,
plus the instants lying exactly on a slice boundary (windows are closed at both ends, so such
an event belongs to two neighbouring windows and must not be folded into either side). All
window sizes and all sample windows are then assembled from the panes, which are a small
fraction of the log. Only sums, counts and first/last values by (timestamp, id) are kept, so
every step is a partial aggregation and a hot market is spread over its panes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
_TYPES = ("price_change", "trade", "volume_update")


def window_stats(
    events: DataFrame, now_ms: int, windows: Sequence[int] = fv.WINDOW_MINUTES
) -> DataFrame:
    """Statistics of each (market, trailing window) with at least one event.

    A single aggregation per market carries all windows side by side, then one row per window
    is unfolded from its result.
    """
    longest = max(windows) * MINUTE_MS
    recent = events.filter(
        F.col("timestamp").between(now_ms - longest, now_ms) & F.col("event_type").isin(*_TYPES)
    )
    aggs = []
    for w in windows:
        inside = F.col("timestamp") >= now_ms - w * MINUTE_MS
        aggs.append(F.struct(*_stat_aggregates(inside)).alias(f"w{w}"))
    wide = recent.groupBy("market_id").agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(w).alias("window_minutes"), F.col(f"w{w}").alias("s"))
            for w in windows
        ]
    )
    long = wide.select("market_id", F.explode(rows).alias("r")).select(
        "market_id", "r.window_minutes", "r.s.*"
    )
    return _finish(long.withColumn("window_end", F.lit(now_ms).cast("long")))


def _stat_aggregates(inside: Column) -> list[Column]:
    kind, value = F.col("event_type"), F.col("new_value")
    at = F.struct("timestamp", "id")
    price = inside & (kind == "price_change")
    return [
        F.min_by(value, F.when(price, at)).alias("price_start"),
        F.max_by(value, F.when(price, at)).alias("price_end"),
        F.count_if(price).alias("price_count"),
        F.count_if(inside & (kind == "trade")).alias("trade_count"),
        F.sum(F.when(inside & (kind == "volume_update"), value)).alias("volume_sum"),
        F.count_if(inside & (kind == "volume_update")).alias("volume_count"),
    ]


def _finish(raw: DataFrame) -> DataFrame:
    """Derive the published columns; windows without events are left out."""
    start, end = F.col("price_start"), F.col("price_end")
    volume = F.when(F.col("volume_count") > 0, F.col("volume_sum")).otherwise(
        F.col("trade_count").cast("double")
    )
    events = F.col("price_count") + F.col("trade_count") + F.col("volume_count")
    return raw.withColumn("event_count", events).filter("event_count > 0").select(
        "market_id",
        "window_minutes",
        (F.col("window_end") - F.col("window_minutes") * F.lit(MINUTE_MS)).alias("window_start"),
        "window_end",
        "price_start",
        "price_end",
        (end - start).alias("price_delta"),
        F.when(start != 0, (end - start) / start).alias("price_change_pct"),
        volume.alias("volume_total"),
        "trade_count",
        "event_count",
    )


def pane_width(*spans_ms: int) -> int:
    out = 0
    for span in spans_ms:
        out = gcd(out, span)
    return out


def window_panes(events: DataFrame, anchor_ms: int, width_ms: int, start_ms: int, end_ms: int) -> DataFrame:
    """(market, lo, hi) partial statistics; lo = hi marks a boundary instant."""
    ts = F.col("timestamp")
    offset = ts - anchor_ms
    on_edge = F.pmod(offset, F.lit(width_ms)) == 0
    lo = ts - F.pmod(offset, F.lit(width_ms))
    kept = events.filter(ts.between(start_ms, end_ms) & F.col("event_type").isin(*_TYPES))
    kind, value, at = F.col("event_type"), F.col("new_value"), F.struct("timestamp", "id")
    price = kind == "price_change"
    return (
        kept.groupBy("market_id", lo.alias("lo"), F.when(on_edge, lo).otherwise(lo + width_ms).alias("hi"))
        .agg(
            F.min_by(value, F.when(price, at)).alias("first_price"),
            F.max_by(value, F.when(price, at)).alias("last_price"),
            F.count_if(price).alias("price_count"),
            F.count_if(kind == "trade").alias("trade_count"),
            F.sum(F.when(kind == "volume_update", value)).alias("volume_sum"),
            F.count_if(kind == "volume_update").alias("volume_count"),
        )
    )


@dataclass(frozen=True)
class EndGrid:
    """Which ends the windows of one size have: every ``stride_ms`` from ``anchor_ms``, within
    [first_ms, last_ms], and optionally one more end off the grid."""

    window_minutes: int
    anchor_ms: int
    stride_ms: int
    first_ms: int
    last_ms: int
    extra_ms: int | None = None

    @property
    def span_ms(self) -> int:
        return self.window_minutes * MINUTE_MS


def grid_ends(anchor: Column, stride: Column, span: Column, lo: Column, hi: Column) -> Column:
    """End times on the grid of the closed windows [end - span, end] that contain [lo, hi]."""
    first = hi + F.pmod(anchor - hi, stride)
    last = lo + span - F.pmod(lo + span - anchor, stride)
    return F.when(first <= last, F.sequence(first, last, stride))


def window_samples(panes: DataFrame, grids: Sequence[EndGrid]) -> DataFrame:
    """Combine panes to the windows of every grid.

    Panes of a market do not overlap in time, so their order is one number and the second
    aggregation runs on plain long and double buffers (hash aggregation, no sort).
    """

    def big(value: int | None) -> Column:
        return F.lit(value).cast("long")

    sizes = F.array(
        *[
            F.struct(
                F.lit(g.window_minutes).alias("window_minutes"),
                big(g.span_ms).alias("span"), big(g.anchor_ms).alias("anchor"),
                big(g.stride_ms).alias("stride"), big(g.first_ms).alias("first_end"),
                big(g.last_ms).alias("last_end"), big(g.extra_ms).alias("extra"),
            )
            for g in grids
        ]
    )
    lo, hi = F.col("lo"), F.col("hi")
    ends = grid_ends(F.col("g.anchor"), F.col("g.stride"), F.col("g.span"), lo, hi)
    if any(g.extra_ms is not None for g in grids):
        nothing = F.array().cast("array<bigint>")
        inside = (lo >= F.col("g.extra") - F.col("g.span")) & (hi <= F.col("g.extra"))
        ends = F.concat(
            F.coalesce(ends, nothing), F.when(inside, F.array("g.extra")).otherwise(nothing)
        )
    position = lo * 2 + (hi > lo).cast("int")  # an instant comes before the slice it opens
    has_price = F.col("price_count") > 0
    rows = (
        panes.withColumn("position", F.when(has_price, position))
        .withColumn("g", F.explode(sizes))
        .withColumn("window_end", F.explode(ends))
        .filter(
            F.col("window_end").between(F.col("g.first_end"), F.col("g.last_end"))
            | F.coalesce(F.col("window_end") == F.col("g.extra"), F.lit(False))
        )
    )
    return _finish(
        rows.groupBy("market_id", "g.window_minutes", "window_end").agg(
            F.min_by("first_price", "position").alias("price_start"),
            F.max_by("last_price", "position").alias("price_end"),
            F.sum("price_count").alias("price_count"),
            F.sum("trade_count").alias("trade_count"),
            F.sum("volume_sum").alias("volume_sum"),
            F.sum("volume_count").alias("volume_count"),
        )
    )


def trailing_samples(
    events: DataFrame,
    now_ms: int,
    windows: Sequence[int] = fv.WINDOW_MINUTES,
    lookback_hours: int = fv.BASELINE_HOURS,
) -> DataFrame:
    """Sample windows of the lookback and the current window of every (market, window size).

    Adds ``is_sample`` (part of the baseline) and ``is_current``. When the window divides the
    lookback the current window is also the last sample.
    """
    lookback = lookback_hours * HOUR_MS
    start = now_ms - lookback
    width = pane_width(lookback, *[w * MINUTE_MS for w in windows])
    oldest = min([start, *[now_ms - w * MINUTE_MS for w in windows]])
    panes = window_panes(events, start, width, oldest, now_ms)
    grids, sampled = [], F.lit(False)
    for w in windows:
        span = w * MINUTE_MS
        apart = lookback % span != 0 or span > lookback  # the current window is no sample then
        grids.append(EndGrid(w, start, span, start + span, now_ms, now_ms if apart else None))
        on_grid = F.pmod(F.col("window_end") - start, F.lit(span)) == 0
        sampled = sampled | (
            (F.col("window_minutes") == w) & on_grid & (F.col("window_end") >= start + span)
        )
    return window_samples(panes, grids).withColumns(
        {"is_sample": sampled, "is_current": F.col("window_end") == now_ms}
    )


def baseline_columns(metric: str, when: Column) -> list[Column]:
    """Aggregates mean / sample stddev / count of one metric over sample windows."""
    name = {"price_change_pct": "price_change_pct", "volume": "volume_total"}[metric]
    value = F.when(when, F.col(name))
    prefix = "pct" if metric == "price_change_pct" else "volume"
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(value), zero).alias(f"{prefix}_mean"),
        F.coalesce(F.nanvl(F.stddev_samp(value), zero), zero).alias(f"{prefix}_stddev"),
        F.count(value).alias(f"{prefix}_samples"),
    ]


def baseline_stats(
    events: DataFrame,
    now_ms: int,
    windows: Sequence[int] = fv.WINDOW_MINUTES,
    lookback_hours: int = fv.BASELINE_HOURS,
) -> DataFrame:
    """Baseline of price change and volume per (market, window size) over the lookback."""
    samples = trailing_samples(events, now_ms, windows, lookback_hours).filter("is_sample")
    everything = F.lit(True)
    return samples.groupBy("market_id", "window_minutes").agg(
        *baseline_columns("price_change_pct", everything), *baseline_columns("volume", everything)
    )
