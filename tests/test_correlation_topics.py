"""Cluster, series and cross-platform correlation; topic clusters."""

import itertools
import json
import math
import random

import pytest

from tidewatch.operators import correlation as k
from tidewatch.operators import topics as t

NOW = 10_000_000_000
MIN = 60_000


def two_market_cluster(rows, s1="price +5%", s2="price +9%", sev=(0.8, 0.6)):
    an = rows.anomalies(dict(id=1, severity=sev[0], detected_at=NOW - 1000, summary=s1),
                        dict(id=2, severity=sev[1], detected_at=NOW - 500, summary=s2))
    li = rows.links(dict(anomaly_id=1, market_id=11, price_delta=0.1, volume_ratio=2.0), dict(anomaly_id=2, market_id=12, price_delta=-0.2))
    return an, li, rows.memberships((11, 1, 0.9), (12, 1, 0.8), (13, 1, 0.7)), rows.clusters((1, "Fed"), (2, "Empty"))


def test_cluster_severity_and_direction(rows):
    an, li, me, cl = two_market_cluster(rows)
    r = k.cluster_anomalies(an, li, me, cl, NOW).collect()
    assert len(r) == 1 and r[0].severity == 0.7 and r[0].direction == "bullish" and r[0].market_count == 2
    assert r[0].summary == "[Fed] 2 markets bullish: cluster anomaly (severity 0.70)"
    found = k.cluster_anomalies(an, li, me, cl, NOW)
    links = {x.market_id: x.price_delta for x in k.cluster_anomaly_links(found, an, li, me, NOW).collect()}
    assert links == {11: 0.1, 12: -0.2}


@pytest.mark.parametrize("s1,s2,want", [("price +1", "price -2", "mixed"), ("price -1", "price -2", "bearish"), ("vol", "z", "undetermined")])
def test_directions(rows, s1, s2, want):
    assert k.cluster_anomalies(*two_market_cluster(rows, s1, s2), NOW).first().direction == want


def test_direction_from_delta(rows):
    assert k.cluster_anomalies(*two_market_cluster(rows, "v", "v"), NOW, mode="delta").first().direction == "mixed"


def test_cluster_dedup_window_and_minimum(rows):
    an, li, me, cl = two_market_cluster(rows)
    emitted = an.unionByName(rows.anomalies(dict(id=3, anomaly_type="cluster", topic_cluster_id=1, detected_at=NOW - 5, status="expired")))
    assert k.cluster_anomalies(emitted, li, me, cl, NOW).count() == 0
    series = an.unionByName(rows.anomalies(dict(id=3, anomaly_type="cluster", topic_cluster_id=None, detected_at=NOW - 5)))
    assert k.cluster_anomalies(series, li, me, cl, NOW).count() == 1  # a NULL cluster blocks nothing
    assert k.cluster_anomalies(an, li, me, cl, NOW + 61 * MIN).count() == 0
    assert k.cluster_anomalies(an, li, me, cl, NOW, min_markets=3).count() == 0


def test_links_equal_brute_force(rows, spark):
    rng = random.Random(3)
    platforms = {i: rng.choice(("kalshi", "polymarket", "third")) for i in range(1, 25)}
    active = {i: rng.random() > 0.2 for i in platforms}
    names = {1: "Beta", 2: "Alpha", 3: "Gamma"}
    members = {(m, c): round(rng.random(), 3) for m in platforms for c in names if rng.random() > 0.4}
    m = rows.markets(*[dict(id=i, platform=p, external_id=f"X-{i}", is_active=active[i]) for i, p in platforms.items()])
    index = k.link_index(rows.memberships(*[(a, c, v) for (a, c), v in members.items()]), m, rows.clusters(*names.items())).cache()
    want, degree = {}, {}
    for c in sorted(names, key=names.get):  # last cluster by name wins
        inside = [a for (a, cc) in members if cc == c and active[a]]
        for a, b in itertools.combinations(sorted(inside), 2):
            if platforms[a] != platforms[b]:
                conf = min(members[a, c], members[b, c])
                want[a, b] = conf
                for x in (a, b):
                    n, best = degree.get((c, x), (0, 0.0))
                    degree[c, x] = (n + 1, max(best, conf))
    assert {(r.cluster_id, r.market_id): (r.partners, r.best_confidence) for r in index.collect()} == degree
    asked = spark.createDataFrame([(b, a) for a, b in want] + [(1, 1)], "market_id_a long, market_id_b long")
    some = {(r.market_id_a, r.market_id_b): r.confidence for r in k.links_of_pairs(index, asked, 0).collect()}
    assert some == want


def test_cross_platform_signal(rows):
    def run(s1, s2, sev=(0.8, 0.6), extra=None):
        an, li, _, _ = two_market_cluster(rows, s1, s2, sev)
        if extra:
            an = an.unionByName(rows.anomalies(extra))
        return k.cross_platform_anomalies(an, li, rows.pairs((11, 12, 0.8), (11, 13, 0.9)), NOW).collect()

    r = run("price +10%", "price -8%")[0]
    assert (r.signal_type, r.direction, r.severity) == ("divergent", "mixed", 0.84)
    assert json.loads(r.metadata)["link_confidence"] == 0.8
    assert run("price +10%", "price +8%")[0].signal_type == "convergent"
    assert run("v", "price +8%")[0].signal_type == "undetermined"
    assert run("price +1", "price +1", (0.95, 0.95))[0].severity == 1.0
    done = dict(id=9, anomaly_type="cross_platform", detected_at=NOW - 9, metadata='{"market_id_a": 12, "market_id_b": 11}')
    assert run("price +1", "price +1", extra=done) == []


def btc(rows, n=5, end=0.55, prefix="BTC-"):
    m = rows.markets(*[dict(id=i, external_id=f"{prefix}{i}") for i in range(1, n + 1)])
    ev = rows.events(*[e for i in range(1, n + 1) for e in (
        dict(id=2 * i, market_id=i, new_value=0.50, timestamp=NOW - 20 * MIN), dict(id=2 * i + 1, market_id=i, new_value=end, timestamp=NOW - MIN))])
    return ev, m


def test_series_pattern(rows):
    ev, m = btc(rows)
    moves = k.series_moves(ev, m, NOW, NOW - 10 * MIN)
    found = k.series_anomalies(moves, rows.anomalies(), NOW)
    r = found.collect()
    assert len(r) == 1 and r[0].direction == "up" and r[0].movers == 5 and r[0].market_count == 5
    assert r[0].summary == "Series BTC: 5/5 markets moved up by avg 10.0% in 30min"
    assert json.loads(r[0].metadata)["series_prefix"] == "BTC"
    assert sorted(map(tuple, k.series_tickers(found, moves).collect())) == [(r[0].id, f"BTC-{i}") for i in range(1, 6)]
    links = k.series_links(found, moves).collect()
    assert len(links) == 5 and links[0].price_delta == pytest.approx(0.10)
    stored = rows.anomalies(dict(id=r[0].id, anomaly_type="cluster", detected_at=NOW, metadata=r[0].metadata))
    assert k.series_anomalies(moves, stored, NOW).count() == 0  # second run
    down = k.series_anomalies(k.series_moves(*btc(rows, end=0.40), NOW, NOW - 10 * MIN), rows.anomalies(), NOW).first()
    assert down.direction == "down" and down.avg_change_pct == pytest.approx(0.2)


def test_series_needs_movers_and_prefix(rows):
    none = rows.anomalies()
    assert k.series_anomalies(k.series_moves(*btc(rows, 2), NOW, NOW - 10 * MIN), none, NOW).count() == 0
    assert k.series_anomalies(k.series_moves(*btc(rows, end=0.51), NOW, NOW - 10 * MIN), none, NOW).count() == 0
    assert k.series_moves(*btc(rows, prefix="ALONE"), NOW, NOW - 10 * MIN).count() == 0
    assert k.series_moves(*btc(rows), NOW, NOW - 30_000).count() == 0  # nothing recent


def test_trending(rows):
    an, li, me, cl = two_market_cluster(rows)
    got = {r.name: (r.market_count, r.anomaly_count, r.max_severity) for r in k.trending_topics(cl, me, li, an).collect()}
    assert got == {"Fed": (3, 2, 0.8), "Empty": (0, 0, None)}


def test_prompts_hold_every_market_once(rows):
    m = rows.markets(*[dict(id=i, external_id=f"X-{i}", title=f"Q{i}", description="d" if i % 2 else None) for i in range(1, 101)])
    batches = t.prompt_batches(t.unassigned_markets(m, rows.memberships((3, 1, 0.9))), buckets=2).collect()
    lines = [line for b in batches for line in b.market_lines.split("\n")]
    assert len(lines) == len(set(lines)) == 99 and max(b.markets for b in batches) == 30
    assert '  [id=5] "Q5" -- d' in lines and '  [id=4] "Q4"' in lines
    inc = t.prompt_batches(m, 1, clusters=rows.clusters((1, "Fed"))).first().prompt
    assert '- "Fed"' in inc and "New markets:" in inc


def replies(spark, *texts):
    return spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(texts)], "reply_id string, content string")


def test_parse_replies(spark):
    good = json.dumps({"clusters": [{"name": "Fed", "description": "d", "markets": [{"market_id": 1, "confidence": 0.9}, {"market_id": 2}]}, {"markets": []}]})
    got = t.parse_batch_replies(replies(spark, f"```json\n{good}\n```", "nothing", "{broken", f"Sure! {good} bye")).collect()
    assert len(got) == 6
    assert [(r.cluster_name, r.market_id, r.confidence) for r in got if r.reply_id == "r0"] == [("Fed", 1, 0.9), ("Fed", 2, 0.5), ("Unknown", None, None)]
    inc = json.dumps({"assignments": [{"market_id": 7, "cluster_name": "New", "is_new_cluster": True, "confidence": 0.8}, {}]})
    got = t.parse_incremental_replies(replies(spark, inc)).collect()
    assert [(r.market_id, r.cluster_name, r.confidence) for r in got] == [(7, "New", 0.8), (0, "Unknown", 0.5)]


def test_assignments(rows, spark):
    doc = json.dumps({"clusters": [{"name": "Fed", "markets": [{"market_id": 1, "confidence": 0.9}, {"market_id": 2, "confidence": 0.3}]},
                                   {"name": "Lonely", "markets": [{"market_id": 2, "confidence": 0.1}]}]})
    a = t.parse_batch_replies(replies(spark, doc))
    cl, me = rows.clusters((1, "Fed")), rows.memberships((1, 1, 0.5), (9, 1, 0.7))
    fresh = t.new_clusters(a, cl, 5)
    assert [r.name for r in fresh.collect()] == ["Lonely"]  # a batch creates it though nobody joins
    once = t.apply_assignments(me, a, cl.unionByName(fresh), 5)
    assert {(r.market_id, r.cluster_id): r.confidence for r in once.collect()} == {(1, 1): 0.9, (9, 1): 0.7}
    twice = t.apply_assignments(once, a, cl.unionByName(fresh), 5)
    assert sorted(twice.collect()) == sorted(once.collect())
    inc = t.parse_incremental_replies(replies(spark, json.dumps({"assignments": [{"market_id": 1, "cluster_name": "Weak", "confidence": 0.2}]})))
    assert t.new_clusters(inc, cl, 5).count() == 0


def test_cluster_stats(rows):
    m = rows.markets(dict(id=1), dict(id=2, external_id="b"), dict(id=3, external_id="c", is_active=False))
    s = t.cluster_stats(m, rows.memberships((1, 1, 0.9)), rows.clusters((1, "A"), (2, "B"))).first()
    assert (s.total_markets, s.unassigned, s.assigned, s.clusters, s.avg_size, s.min_size, s.max_size) == (3, 1, 2, 2, 0.5, 0, 1)


def test_candidate_clusters_share_telling_words(rows, spark):
    markets = rows.markets(*[dict(id=i, external_id=f"T{i}", title=x) for i, x in enumerate(
        ["Will the Fed cut rates?", "Fed and ECB rates", "Who wins the cup", "the the", "", "rates of the ECB", "Lakers"], 1)])
    names = [("Fed policy", "rates of the Fed"), ("ECB policy", "rates of the ECB"), ("Cups", "the cup"), ("Sports", "Lakers and others")]
    clusters = spark.createDataFrame([(i, n, d, 0, 0) for i, (n, d) in enumerate(names, 1)], "id long, name string, description string, created_at long, updated_at long")
    got = {(r.market_id, r.name): (r.shared, r.weight) for r in t.candidate_clusters(markets, clusters, common=0.5).collect()}
    once, twice = int(1000 * math.log(4)), int(1000 * math.log(2))
    # "the" is in three of four clusters and no key; "rates" is in two, "fed", "ecb", "cup", "lakers" and "and" in one each
    assert got == {
        (1, "Fed policy"): (2, once + twice), (1, "ECB policy"): (1, twice),
        (2, "Fed policy"): (2, once + twice), (2, "ECB policy"): (2, once + twice), (2, "Sports"): (1, once),
        (3, "Cups"): (1, once), (6, "ECB policy"): (2, once + twice), (6, "Fed policy"): (1, twice), (7, "Sports"): (1, once),
    }
    first = t.candidate_clusters(markets, clusters, per_market=1, common=0.5)
    assert {(r.market_id, r.name) for r in first.collect()} == {(1, "Fed policy"), (2, "ECB policy"), (3, "Cups"), (6, "ECB policy"), (7, "Sports")}
    prompts = {r.batch: r.prompt for r in t.prompt_batches(markets, 1, 3, candidates=first).collect()}
    assert '- "Fed policy": rates of the Fed' in prompts[0] and '- "Cups"' in prompts[0] and "Sports" not in prompts[0]
    assert "Fed policy" not in prompts[1] and '- "ECB policy"' in prompts[1] and '- "Sports"' in prompts[2]
    assert t.candidate_clusters(markets, clusters.limit(0)).count() == 0


def test_buckets_follow_the_number_of_markets(rows):
    assert [t.buckets_for(n) for n in (0, 1, 3000, 3001, 3_000_000)] == [1, 1, 1, 2, 1000]
    markets = rows.markets(*[dict(id=i, external_id=f"T{i}") for i in range(1, 8)])
    assert {(r.bucket, r.batch) for r in t.prompt_batches(markets, batch_size=3).collect()} == {(0, 0), (0, 1), (0, 2)}
