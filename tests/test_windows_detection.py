"""Window statistics, baselines, detection and lifecycle."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detection as d
from tidewatch.operators import windows as w
from tidewatch.plans import backtest as bt

MIN = 60_000
HOUR = 60 * MIN


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


def test_price_statistics(rows):
    ev = rows.prices((0.50, 100_000), (0.55, 200_000), (0.60, 300_000))
    r = one(w.window_stats(ev, 600_000, [10]))
    assert (r.price_start, r.price_end, r.event_count) == (0.50, 0.60, 3)
    assert r.price_delta == pytest.approx(0.10) and r.price_change_pct == pytest.approx(0.20)


def test_volume_and_trade_proxy(rows):
    vol = rows.events(*[dict(event_type="volume_update", new_value=v, timestamp=1000 * i)
                        for i, v in enumerate((100.0, 200.0, 50.0))])
    assert one(w.window_stats(vol, 600_000, [10])).volume_total == 350.0
    trades = rows.events(*[dict(event_type="trade", new_value=0.5, timestamp=i) for i in range(3)])
    r = one(w.window_stats(trades, 600_000, [10]))
    assert (r.volume_total, r.trade_count) == (3.0, 3)


def test_outside_window_ignored_and_edges_closed(rows):
    now = 1_000_000
    ev = rows.prices((0.10, now - 5 * MIN - 1), (0.70, now - MIN), (0.9, now + 1))
    r = one(w.window_stats(ev, now, [5]))
    assert (r.price_start, r.price_end, r.price_delta) == (0.70, 0.70, 0.0)
    edge = rows.prices((0.2, now - 5 * MIN), (0.4, now))
    assert one(w.window_stats(edge, now, [5])).event_count == 2


def test_ties_follow_id(rows):
    r = one(w.window_stats(rows.prices((0.3, 10), (0.4, 10), (0.5, 10)), 100, [1]))
    assert (r.price_start, r.price_end) == (0.3, 0.5)


def test_zero_start_has_no_pct(rows):
    r = one(w.window_stats(rows.prices((0.0, 10), (0.4, 20)), 100, [1]))
    assert r.price_change_pct is None and r.price_delta == pytest.approx(0.4)


def test_baseline_without_data_is_empty(rows):
    assert w.baseline_stats(rows.events(), 10**9).count() == 0


def brute(events, now, minutes, lookback_h):
    """Straight loop over closed sample windows, one market."""
    span, start = minutes * MIN, now - lookback_h * HOUR
    pct, vol = [], []
    end = start + span
    while end <= now:
        inside = [e for e in events if end - span <= e[2] <= end]
        prices = [e for e in sorted(inside, key=lambda e: (e[2], e[0])) if e[1] == "price_change"]
        vols = [e[3] for e in inside if e[1] == "volume_update"]
        trades = [e for e in inside if e[1] == "trade"]
        if prices or vols or trades:
            if prices and prices[0][3] != 0:
                pct.append((prices[-1][3] - prices[0][3]) / prices[0][3])
            vol.append(sum(vols) if vols else float(len(trades)))
        end += span
    return pct, vol


@pytest.mark.parametrize("windows", [(5, 60), (7, 90), (60, 1440)])
def test_baseline_equals_brute_force(rows, windows):
    rng = random.Random(11)
    now = 2_000_000_000_000
    kinds = ("price_change", "trade", "volume_update")
    raw = []
    for i in range(400):
        # a quarter of the events sit exactly on window edges
        ts = now - rng.randrange(0, 24 * HOUR)
        if i % 4 == 0:
            ts = now - rng.randrange(0, 24 * 12 + 1) * 5 * MIN
        raw.append((i, rng.choice(kinds), ts, round(rng.random(), 3)))
    ev = rows.events(*[dict(id=i, event_type=k, timestamp=t, new_value=v) for i, k, t, v in raw])
    got = {r.window_minutes: r for r in w.baseline_stats(ev, now, windows, 24).collect()}
    for minutes in windows:
        pct, vol = brute(raw, now, minutes, 24)
        r = got[minutes]
        assert (r.pct_samples, r.volume_samples) == (len(pct), len(vol))
        assert r.volume_mean == pytest.approx(statistics.mean(vol))
        assert r.pct_mean == pytest.approx(statistics.mean(pct))
        assert r.volume_stddev == pytest.approx(statistics.stdev(vol) if len(vol) > 1 else 0.0)
        assert r.pct_stddev == pytest.approx(statistics.stdev(pct) if len(pct) > 1 else 0.0)
    current = d.window_scores(ev, now, [d.WindowRule(m) for m in windows]).orderBy("window_minutes").collect()
    plain = w.window_stats(ev, now, windows).orderBy("window_minutes").collect()
    assert [(r.window_minutes, r.price_delta, r.event_count) for r in current] == [
        (r.window_minutes, r.price_delta, r.event_count) for r in plain
    ]


def found(rows, ev, now, windows=(5,), titles=((1, "Will it rain?"),)):
    m = rows.markets(*[dict(id=i, title=t, external_id=f"X-{i}") for i, t in titles])
    return d.detect_single(d.window_scores(ev, now, [d.WindowRule(x) for x in windows]), m)


def test_detection_threshold_and_severity(rows):
    now = 10 * HOUR
    assert found(rows, rows.prices((0.50, now - 2000), (0.52, now - 1000)), now).count() == 0
    hit = one(found(rows, rows.prices((0.50, now - 2000), (0.70, now - 1000)), now))
    assert hit.severity == pytest.approx(round(math.log10(0.4 / 0.1 + 1) / math.log10(101), 4))
    assert hit.summary == "Will it rain?: +40.0% (50%→70%) in 5min window"
    assert one(found(rows, rows.prices((0.30, now - 2000), (0.60, now - 1000)), now)).severity > 0.5


def test_long_and_missing_titles(rows):
    now = 10 * HOUR
    ev = rows.prices((0.5, now - 2000), (0.9, now - 1000))
    assert one(found(rows, ev, now, titles=((1, "x" * 90),))).summary.startswith("x" * 90 + ":")
    assert one(found(rows, ev, now, titles=((2, "other"),))).summary.startswith("market_id=1:")


def test_volume_spike(rows):
    now = 100 * HOUR
    quiet = [dict(event_type="volume_update", new_value=1.0, timestamp=now - k * 5 * MIN - 1000) for k in range(1, 250)]
    spike = [dict(event_type="volume_update", new_value=100.0, timestamp=now - 1000)]
    hit = one(found(rows, rows.events(*quiet, *spike), now))
    assert hit.severity == 1.0 and "100 vol" in hit.summary and hit.volume_ratio > 3


def test_detect_new_keeps_strongest_and_skips_busy(rows):
    now = 10 * HOUR
    ev = rows.prices((0.5, now - 50 * MIN), (0.6, now - 2000), (0.7, now - 1000)).unionByName(
        rows.prices((0.5, now - 2000), (0.7, now - 1000), market_id=2)
    )
    all_found = found(rows, ev, now, (5, 60))
    an, li = rows.anomalies(dict(id=9)), rows.links(dict(anomaly_id=9, market_id=2))
    best = d.detect_new(all_found, an, li, (5, 60)).collect()
    assert [(r.market_id, r.window_minutes) for r in best] == [(1, 60)]
    again = d.detect_new(all_found, an, rows.links(dict(anomaly_id=9, market_id=1), dict(anomaly_id=9, market_id=2)), (5, 60))
    assert again.count() == 0
    # equal severity: the window configured first
    tie = d.detect_new(found(rows, rows.prices((0.5, now - 2000), (0.7, now - 1000)), now, (60, 5)), an, li, (60, 5))
    assert one(tie).window_minutes == 60


def test_lifecycle_and_reports(rows):
    an = rows.anomalies(
        dict(id=1, severity=0.8, detected_at=100), dict(id=2, severity=0.5, detected_at=900),
        dict(id=3, severity=0.1, detected_at=950, status="expired", anomaly_type="cluster",
             metadata='{"cluster_name": "C", "direction": "mixed"}'),
    )
    assert {r.id: r.status for r in d.expire_anomalies(an, 500).collect()} == {1: "expired", 2: "active", 3: "expired"}
    s = one(d.anomaly_stats(an))
    assert (s.active_count, s.high, s.medium, s.low) == (3, 1, 1, 1) and s.avg_severity == pytest.approx(1.4 / 3)
    assert one(d.anomaly_stats(an.limit(0))).avg_severity == 0.0
    rep = one(d.signal_report(an, 1000, 1))
    assert (rep.total, rep.single_market, rep.cluster, rep.gate) == (3, 2, 1, "PASS")
    assert one(d.cluster_signal_detail(an, 1000)).cluster_name == "C"
    assert [r.id for r in d.query_anomalies(an, status="active").collect()] == [2, 1]
    upd = d.update_anomalies(an, an.filter("id = 2").selectExpr("id", "'acknowledged' as status", "cast(null as string) as metadata"))
    assert {r.id: r.status for r in upd.collect()}[2] == "acknowledged"


def test_backtest_matches_single_cycles(rows):
    """Every cursor of the replay equals a detection run at that time."""
    rng = random.Random(5)
    now = 400 * HOUR
    events = []
    for m in (1, 2, 3):
        for _ in range(150):
            events.append(dict(market_id=m, event_type=rng.choice(("price_change", "trade", "volume_update")),
                               timestamp=now - rng.randrange(0, 48 * HOUR), new_value=round(rng.random() + 0.01, 2)))
        events += [dict(market_id=m, timestamp=now - h * HOUR, new_value=round(rng.random() + 0.01, 2)) for h in range(48)]
    ev = rows.events(*events).cache()
    rules = [d.WindowRule(30), d.WindowRule(60), d.WindowRule(120)]
    got = {(r.market_id, r.cursor_ms): (r.severity, r.window_minutes)
           for r in bt.backtest_candidates(ev, now, rules, days=2, step_hours=1, baseline_hours=12).collect()}
    assert got
    for hours_back in (0, 7, 20, 36):
        cursor = now - hours_back * HOUR
        past = ev.filter(F.col("timestamp") <= cursor)
        want = {r.market_id: (r.severity, r.window_minutes) for r in d.strongest_per_market(
            d.detect_single(d.window_scores(past, cursor, rules, 12), rows.markets()), (30, 60, 120)).collect()}
        assert {m: v for (m, c), v in got.items() if c == cursor} == want


def test_suppression(rows, spark):
    c = spark.createDataFrame([(1, t, 0.5, 5) for t in (10, 20, 35, 60)] + [(2, 5, 0.1, 5)],
                              "market_id long, cursor_ms long, severity double, window_minutes int")
    assert {(r.market_id, r.cursor_ms) for r in bt.suppress(c).collect()} == {(1, 10), (2, 5)}
    assert {(r.market_id, r.cursor_ms) for r in bt.suppress(c, 20).collect()} == {(1, 10), (1, 35), (1, 60), (2, 5)}
