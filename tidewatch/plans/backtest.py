"""Replay of the detector over past times (cursors), all cursors in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.keyed import with_totals
from tidewatch.operators.detection import DEFAULT_RULES, WindowRule, scored, severity_counts
from tidewatch.operators.windows import (
    HOUR_MS,
    MINUTE_MS,
    EndGrid,
    grid_ends,
    pane_width,
    window_panes,
    window_samples,
)


def backtest_candidates(
    events: DataFrame,
    now_ms: int,
    rules: Sequence[WindowRule] = DEFAULT_RULES,
    days: int = 7,
    step_hours: int = 1,
    baseline_hours: int = fv.BASELINE_HOURS,
) -> DataFrame:
    """Strongest window per (market, cursor) that would have fired, before suppression.

    Sample windows of neighbouring cursors overlap, so each is built once from panes; the
    baseline of a cursor is a sliding frame over the samples of its own phase. A frame's rows
    are bounded by the replayed time, not by the market's traffic.
    """
    step, lookback = step_hours * HOUR_MS, baseline_hours * HOUR_MS
    for r in rules:
        if lookback % (r.window_minutes * MINUTE_MS):
            raise ValueError("each window must divide the baseline")
    first = now_ms - days * 86_400_000 + lookback
    if first > now_ms:
        raise ValueError("the replayed days must cover the baseline")
    last = first + (now_ms - first) // step * step
    spans = {r.window_minutes: r.window_minutes * MINUTE_MS for r in rules}
    width = pane_width(step, lookback, *spans.values())
    panes = window_panes(events, first, width, first - lookback, last)
    grids = [
        EndGrid(minutes, first, pane_width(step, span), first - lookback + span, last)
        for minutes, span in spans.items()
    ]
    samples = window_samples(panes, grids)
    span = F.col("window_minutes").cast("long") * F.lit(MINUTE_MS)
    phase = F.pmod(F.col("window_end") - F.lit(first), span)
    # samples of one phase are a window apart, so this frame holds exactly those of the lookback
    frame = (
        Window.partitionBy("market_id", "window_minutes", "phase").orderBy("window_end")
        .rangeBetween(-(lookback - 1), 0)
    )
    zero = F.lit(0.0)
    stats = samples.withColumn("phase", phase).withColumns(
        {
            "pct_mean": F.coalesce(F.avg("price_change_pct").over(frame), zero),
            "pct_stddev": F.coalesce(
                F.nanvl(F.stddev_samp("price_change_pct").over(frame), zero), zero
            ),
            "volume_mean": F.coalesce(F.avg("volume_total").over(frame), zero),
        }
    )
    at_cursor = (F.col("window_end") >= first) & (F.pmod(F.col("window_end") - first, F.lit(step)) == 0)
    fired = scored(stats.filter(at_cursor), rules).filter("severity > 0")
    position = F.array_position(F.array(*[F.lit(r.window_minutes) for r in rules]), F.col("window_minutes"))
    best = fired.groupBy("market_id", F.col("window_end").alias("cursor_ms")).agg(
        F.max_by(F.struct("severity", "window_minutes"), F.struct("severity", -position)).alias("b")
    ).select("market_id", "cursor_ms", "b.*")
    return best.join(active_at_cursors(events, first, last, step), ["market_id", "cursor_ms"], "left_semi")


def active_at_cursors(events: DataFrame, first: int, last: int, step: int) -> DataFrame:
    """(market_id, cursor_ms) with an event of any type in [cursor - step, cursor]."""
    ts = F.col("timestamp")
    wide = [F.lit(v).cast("long") for v in (first, step, step)]
    return (
        events.filter(ts.between(first - step, last))
        .select("market_id", F.explode(grid_ends(*wide, ts, ts)).alias("cursor_ms"))
        .filter(F.col("cursor_ms").between(first, last))
        .distinct()
    )


def suppress(candidates: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """Candidates that would be stored: an active anomaly blocks its market until it expires.

    Without expiry only the first candidate of a market counts. With expiry a market's candidates, at most
    one per cursor, are folded in order of time; the fold holds those kept and the time up to which
    the market is blocked.
    """
    rest = [c for c in candidates.columns if c != "market_id"]
    if expiry_ms is None:
        return (
            candidates.groupBy("market_id")
            .agg(F.min_by(F.struct(*rest), "cursor_ms").alias("c"))
            .select("market_id", "c.*")
        )

    others = [c for c in rest if c != "cursor_ms"]
    in_order = candidates.groupBy("market_id").agg(F.sort_array(F.collect_list(F.struct("cursor_ms", *others))).alias("all"))
    kind = in_order.schema["all"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(None).cast("long").alias("until"))

    def step(held, c):
        blocked = F.coalesce(c["cursor_ms"] <= held["until"], F.lit(False))
        taken = F.struct(F.concat(held["kept"], F.array(c)).alias("kept"), (c["cursor_ms"] + expiry_ms).alias("until"))
        return F.when(blocked, held).otherwise(taken)

    kept = in_order.select("market_id", F.explode(F.aggregate("all", start, step, lambda held: held["kept"])).alias("c"))
    return kept.select("market_id", "c.*").select(candidates.columns)


def backtest_report(
    events: DataFrame,
    now_ms: int,
    rules: Sequence[WindowRule] = DEFAULT_RULES,
    days: int = 7,
    step_hours: int = 1,
    baseline_hours: int = fv.BASELINE_HOURS,
    expiry_ms: int | None = None,
) -> DataFrame:
    """Cycles with activity, anomalies found, rate per day and severity buckets."""
    step, lookback = step_hours * HOUR_MS, baseline_hours * HOUR_MS
    first = now_ms - days * 86_400_000 + lookback
    last = first + (now_ms - first) // step * step
    found = suppress(
        backtest_candidates(events, now_ms, rules, days, step_hours, baseline_hours), expiry_ms
    )
    cycles = active_at_cursors(events, first, last, step).agg(
        F.countDistinct("cursor_ms").alias("cycles")
    )
    totals = found.agg(F.count("*").alias("total"), *severity_counts())
    per_day = F.col("total") / F.lit(float(max(days, 1)))
    return (
        with_totals(cycles, totals)
        .withColumn("per_day", per_day)
        .withColumn(
            "gate", F.when(F.col("per_day") < fv.MAX_ALERTS_PER_DAY, "PASS").otherwise("FAIL")
        )
    )
