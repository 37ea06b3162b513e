"""Health scores, catalyst attribution, narratives and alerts."""

import bisect
import json
import random

import pytest

from tidewatch import schemas
from tidewatch.operators import alerts as a
from tidewatch.operators import catalyst as c
from tidewatch.operators import detection as d
from tidewatch.operators import health as h
from tidewatch.operators import narrative as n

NOW = 10_000_000


def trade(price, ago_s, count="10", ticker="T", side="yes", **kw):
    return dict(event_type="trade", new_value=price, timestamp=NOW - int(ago_s * 1000),
                metadata=json.dumps({"ticker": ticker, "count": count, "taker_side": side}), **kw)


def tick(price, ago_s, ticker="T"):
    return dict(new_value=price, timestamp=NOW - int(ago_s * 1000), metadata=json.dumps({"ticker": ticker}))


def points(rows, *ev):
    return h.trades_enriched(rows.events(*ev))


def books(spark, *r):
    return spark.createDataFrame(list(r), "ticker string, timestamp long, bid_depth double, ask_depth double, spread double")


def test_trades_need_a_ticker_and_a_size(rows):
    got = points(rows, trade(0.5, 1), trade(0.5, 1, count="bad"), trade(0.5, 1, count=None), trade(0.5, 1, ticker=""),
                 dict(event_type="trade", new_value=0.5, metadata="nope"), tick(0.4, 1)).orderBy("id").collect()
    assert [r.size for r in got] == [10.0, 1.0, 1.0, None] and got[0].dollars == 5.0


def test_flow_scores(rows):
    p = points(rows, trade(0.5, 10, "2000"), trade(0.5, 20, "100"), trade(0.5, 1000))
    r = h.trade_flow_scores(h.recent_trades(p, NOW)).first()
    assert r.trade_count == 2 and r.trade_velocity == pytest.approx(2 / 15 / 10) and r.whale_activity == pytest.approx(1000 / 1050)
    zero = h.trade_flow_scores(h.recent_trades(points(rows, trade(0.0, 10)), NOW)).first()
    assert zero.whale_activity == 0.0


def test_orderbook_scores(spark):
    b = books(spark, ("T", 1, 1.0, 1.0, 0.0), ("T", 2, 90.0, 10.0, 0.05), ("E", 1, 0.0, 0.0, 0.5))
    got = {r.ticker: r for r in h.orderbook_scores(b).collect()}
    assert got["T"].orderbook_imbalance == pytest.approx(0.8) and got["T"].spread_tightness == pytest.approx(0.5)
    assert got["E"].orderbook_imbalance == 0.0 and got["E"].spread_tightness == 0.0


@pytest.mark.parametrize("prices,low,high", [
    ([0.40 + i * 0.01 for i in range(20)], 0.5, 1.0), ([0.5 + (i % 2) * 0.01 for i in range(20)], 0.0, 0.3), ([0.5, 0.6], 0.0, 0.0), ([0.5] * 9, 0.0, 0.0)])
def test_momentum(rows, prices, low, high):
    p = points(rows, *[tick(v, 600 - i) for i, v in enumerate(prices)])
    assert low <= h.momentum(p, NOW).first().momentum <= high


def test_health_combines_sides(rows, spark):
    p = points(rows, trade(0.5, 10), tick(0.4, 20, "QUIET"))
    b = books(spark, ("BOOK", 1, 90.0, 10.0, 0.05))
    got = {r.ticker: r for r in h.health_scores(p, b, NOW).collect()}
    assert set(got) == {"T", "BOOK"}  # a price alone is not activity
    assert got["T"].spread_tightness == 0.5 and got["BOOK"].health_score == pytest.approx(0.2 * 0.8 + 0.15 * 0.5)
    assert h.health_scores(p, b, NOW, top=1).first().ticker == "BOOK"
    assert {r.ticker for r in h.stale_tickers(p, NOW + 3_605_000).collect()} == {"QUIET", "T"}
    assert {r.ticker for r in h.stale_tickers(p, NOW + 3_585_000).collect()} == {"QUIET"}


def anomaly(spark, minutes=15):
    return spark.createDataFrame([(1, 1, minutes, NOW - minutes * 60_000, NOW)],
                                 "anomaly_id long, market_id long, window_minutes int, window_start long, detected_at long")


def analyzed(rows, spark, *ev, market=None, minutes=15):
    an = anomaly(spark, minutes)
    return c.catalyst_analysis(an, c.events_of_anomalies(an, rows.events(*ev)), rows.markets(market or dict(title="M", category="Politics", external_id="ABC-1")))


def test_whale(rows, spark):
    r = analyzed(rows, spark, trade(0.6, 10, "2000"), trade(0.6, 20, "3000"), trade(0.6, 30, "10")).first()
    assert r.catalyst_type == "whale" and r.confidence > 0.3 and r.series_prefix == "ABC" and r.taker_buy_pct == 1.0


def test_news_and_momentum_and_unknown(rows, spark):
    burst = [trade(0.5, 100 + i) for i in range(9)] + [trade(0.5, 800)]
    r = analyzed(rows, spark, *burst, tick(0.5, 800), tick(0.6, 5)).first()
    assert r.catalyst_type == "news" and r.burst_trade_pct == pytest.approx(0.9) and r.burst_duration_seconds == 8.0
    spread = [trade(0.5, 30 + i * 80, side="no") for i in range(11)]
    r = analyzed(rows, spark, *spread, tick(0.5, 800), tick(0.6, 5)).first()
    assert r.catalyst_type == "momentum" and not r.burst_detected and r.direction == "up" and r.taker_buy_pct == 0.0
    r = analyzed(rows, spark).first()
    assert r.catalyst_type == "unknown" and r.confidence == 0.1 and r.direction == "unknown" and r.trade_count == 0


def test_burst_against_brute_force(rows, spark):
    import random
    rng = random.Random(2)
    for _ in range(4):
        times = sorted(rng.choice((rng.randrange(0, 899), rng.randrange(0, 120))) for _ in range(rng.randrange(5, 25)))
        ev = [trade(0.5, s) for s in times]
        stamps = sorted(NOW - s * 1000 for s in times)
        width = 15 * 60_000 // 5
        best = max((sum(t <= u <= t + width for u in stamps), -t) for t in stamps)
        share, start = best[0] / len(stamps), -best[1]
        inside = [u for u in stamps if start <= u <= start + width]
        an = anomaly(spark)
        r = c.burst_detection(c.events_of_anomalies(an, rows.events(*ev))).first()
        assert r.burst_detected == (share >= 0.6)
        if share >= 0.6:
            assert r.burst_trade_pct == pytest.approx(share)
            assert r.burst_duration_seconds == (max(inside) - min(inside)) / 1000


def test_all_events_of_the_window_and_no_others(rows, spark):
    an = anomaly(spark)
    ev = rows.events(*[trade(0.5, 1 + i * 0.5) for i in range(600)], trade(0.5, 901), trade(0.5, 1, market_id=2))
    kept = c.events_of_anomalies(an, ev)
    assert kept.count() == 600 and kept.agg({"timestamp": "min"}).first()[0] == NOW - 300_500


def test_signals_of_a_hundred_thousand_events_equal_brute_force(rows, spark):
    rng = random.Random(11)
    stamps = [NOW - int(rng.choice([rng.uniform(0, 900_000), rng.gauss(300_000, 20_000)])) for _ in range(100_000)]
    stamps = [min(NOW, max(NOW - 900_000, t)) for t in stamps]
    log = spark.createDataFrame(
        [(i, 1, "trade" if i % 3 else "price_change", None, 0.25 + (i % 512) / 1024, '{"count": "%d"}' % (i % 4096) if i % 3 else None, t)
         for i, t in enumerate(stamps)], schemas.EVENTS)
    got = c.event_signals(c.events_of_anomalies(anomaly(spark), log)).first()
    trades = sorted(t for i, t in enumerate(stamps) if i % 3)
    width = 900_000 // 5
    best = max((bisect.bisect_right(trades, t + width) - bisect.bisect_left(trades, t), -t) for t in set(trades))
    dollars = [(0.25 + (i % 512) / 1024) * (i % 4096) for i in range(100_000) if i % 3]
    price = {(t, i): 0.25 + (i % 512) / 1024 for i, t in enumerate(stamps) if not i % 3}
    assert got.trade_count == len(trades) and got.burst_detected == (best[0] / len(trades) >= 0.6)
    if got.burst_detected:
        assert got.burst_trade_pct == pytest.approx(best[0] / len(trades))
    assert got.whale_trade_pct == pytest.approx(sum(d for d in dollars if d >= 500) / sum(dollars))
    assert (got.price_from, got.price_to) == (price[min(price)], price[max(price)])


def test_template_text(rows, spark):
    t = n.template_narrative(analyzed(rows, spark, trade(0.6, 10, "2000"), trade(0.6, 20, "3000"), trade(0.6, 30, "10"),
                                      tick(0.5, 40), tick(0.7, 5))).first().template
    assert t.headline == "Large trades drove M surged 40.0%"
    assert t.narrative.startswith("M surged 40.0% from 50% to 70%. 100% of volume came from large trades")
    assert t.signals == ["up 40.0%", "3 trades", "100% whale volume", "100% buy-side"] and t.source == "template"
    plain = n.template_narrative(analyzed(rows, spark, tick(0.5, 40), tick(0.5, 5))).first().template
    assert plain.headline == "M held steady 0.0%" and plain.narrative == "M held steady 0.0% from 50% to 50%. Category: Politics."


def test_enrichment_feed_and_pairs(rows, spark):
    stored = rows.anomalies(dict(id=1, summary="M: +40%", detected_at=NOW), dict(id=2, summary="x", metadata="not json"),
                            dict(id=3, summary="S: y", metadata='{"catalyst_type": "whale", "whale_trade_pct": 0.8, "trade_count": 4}'))
    market = rows.markets(dict(title="M"))
    ev = rows.events(tick(0.5, 40), tick(0.7, 5))
    templ = n.enrich_anomalies(stored, anomaly(spark), ev, market)
    told = spark.createDataFrame([(1, '```json\n{"headline": "H", "narrative": "N", "confidence": 7}\n```')], "anomaly_id long, content string")
    both = n.enrich_anomalies(stored, anomaly(spark), ev, market, n.parse_narrative_replies(told))
    feed = {r.anomaly_id: r.catalyst for r in n.anomaly_feed(d.active_anomalies_view(templ, rows.clusters())).collect()}
    assert feed[2] is None and feed[1].source == "template" and not feed[1].model_available
    assert feed[3].headline == "Large trades drove S moved 0.0%"  # rendered from the stored signals
    f2 = {r.anomaly_id: r.catalyst for r in n.anomaly_feed(d.active_anomalies_view(both, rows.clusters())).collect()}
    assert (f2[1].headline, f2[1].source, f2[1].confidence) == ("H", "llm", 1.0) and f2[1].template_headline == "M surged 40.0%"
    pair = n.narrative_pairs(both).collect()
    assert [(r.id, r.llm_headline, r.template_headline) for r in pair] == [(1, "H", "M surged 40.0%")]
    assert n.narrative_pairs(templ).first().llm_headline == "(no LLM)"


def test_bad_reply_and_cost(spark):
    r = n.parse_narrative_replies(spark.createDataFrame([(1, "z" * 900)], "anomaly_id long, content string")).first()
    assert (r.headline, len(r.narrative), r.confidence) == ("Analysis unavailable", 900, 0.5)
    cost = c.reply_cost(spark.createDataFrame([(1_000_000, 100_000), (0, 100_000)], "input_tokens long, output_tokens long")).first()
    assert (cost.total_requests, cost.total_cost_usd) == (2, pytest.approx(6.0))


def test_prompt_lists_news(rows, spark):
    news = spark.createDataFrame([(1, i, f"t{i}", "Wire", "snip" if i == 0 else "") for i in range(7)],
                                 "anomaly_id long, item_pos int, title string, source string, snippet string")
    text = n.narrative_prompts(analyzed(rows, spark, tick(0.5, 4)), news).first().prompt
    assert "1. [Wire] t0\n   snip" in text and "7. [Wire] t6" in text
    assert "(No recent news found)" in n.narrative_prompts(analyzed(rows, spark, tick(0.5, 4)), news.limit(0)).first().prompt


USERS = "user_id string, categories array<string>, platforms array<string>, alerts_enabled boolean, email_notifications boolean"
FEED = "anomaly_id long, severity double, detected_at long, summary string, cluster_name string, catalyst_type string, platform string"


def matched(spark, users, feed, sent=(), per_hour=10):
    s = spark.createDataFrame(list(sent), "user_id string, created_at long")
    u = a.alertable_users(spark.createDataFrame([(*x, True, False) if len(x) == 3 else x for x in users], USERS))
    f = a.labelled(spark.createDataFrame(feed, FEED))
    got = a.matched_and_throttled(f, u, s, NOW, per_hour).orderBy("user_id", "seq").collect()
    return [(r.user_id, r.anomaly_id) for r in got]


def test_preferences(spark):
    feed = [(1, 0.5, 10, "s", "Politics", None, "kalshi"), (2, 0.5, 20, "s", " ", "whale", ""), (3, 0.5, 30, "s", None, None, "polymarket")]
    users = [("all", None, []), ("pol", ["POLITICS", "politics"], None), ("whale", ["Whale"], []), ("kal", [], ["Kalshi"]), ("off", [], [], False, False)]
    assert matched(spark, users, feed) == [("all", 3), ("all", 2), ("all", 1), ("kal", 2), ("kal", 1), ("pol", 3), ("pol", 1), ("whale", 3), ("whale", 2)]


def test_throttle_is_exact(spark):
    import random
    rng = random.Random(9)
    cats, plats = ["a", "b", "c", ""], ["kalshi", "polymarket", ""]
    feed = [(i, 0.5, rng.randrange(50), "s", rng.choice(cats), None, rng.choice(plats)) for i in range(1, 120)]
    users = [(f"u{i}", rng.sample(cats[:3], rng.randrange(0, 3)), rng.sample(plats[:2], rng.randrange(0, 3))) for i in range(12)]
    sent = [(f"u{i % 12}", NOW - rng.randrange(0, 7_200_000)) for i in range(25)]
    want = []
    for uid, uc, up in sorted(users):
        room = 4 - sum(1 for x, t in sent if x == uid and t > NOW - 3_600_000)
        hits = [f for f in sorted(feed, key=lambda f: (-f[2], -f[0]))
                if (not uc or not f[4] or f[4] in uc) and (not up or not f[6] or f[6] in up)]
        want += [(uid, f[0]) for f in hits[:max(room, 0)]]
    assert matched(spark, users, feed, sent, per_hour=4) == want


def test_inbox(spark):
    al = spark.createDataFrame([("u", "anomaly", "t", "m", i, None, i == 1, i) for i in range(1, 5)] + [("v", "anomaly", "t", "m", 1, None, False, 1)],
                               "user_id string, type string, title string, message string, anomaly_id long, market_id long, is_read boolean, created_at long")
    assert {r.user_id: r.unread for r in a.unread_count(al).collect()} == {"u": 3, "v": 1}
    assert sorted(r.anomaly_id for r in a.user_alerts(al, 2).filter("user_id = 'u'").collect()) == [3, 4]
    read = a.mark_read(al, spark.createDataFrame([("u", 2), ("u", 2), ("x", 1)], "user_id string, anomaly_id long"))
    assert sorted((r.user_id, r.anomaly_id) for r in read.filter("is_read").collect()) == [("u", 1), ("u", 2)]
    users = spark.createDataFrame([("u", ["a"], None, None, None), ("w", [], [], False, True)], USERS)
    change = spark.createDataFrame([("u", None, ["kalshi"], None, None), ("ghost", ["x"], None, None, None)], USERS)
    got = {r.user_id: r for r in a.update_preferences(users, change).collect()}
    assert set(got) == {"u", "w"} and got["u"].categories == ["a"] and got["u"].platforms == ["kalshi"]
    assert got["u"].alerts_enabled and got["u"].email_notifications is False and got["w"].alerts_enabled is False
    made = a.create_alerts(spark.createDataFrame([("u", 7, "sum", "head")], "user_id string, anomaly_id long, summary string, headline string"), 5).first()
    assert (made.title, made.message, made.is_read, made.created_at) == ("head", "sum", False, 5)
    new = a.new_anomalies(spark.createDataFrame([(1,), (2,), (None,)], "anomaly_id long"), spark.createDataFrame([(1,)], "anomaly_id long"))
    assert [r.anomaly_id for r in new.collect()] == [2]
