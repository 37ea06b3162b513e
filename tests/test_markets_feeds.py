"""Feed normalizers and the market dimension."""

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.pricing import category_from_title, kalshi_yes_price, polymarket_yes_price, standard_category
from tidewatch.functions.text import fixed, iso_millis, mean_exact, percent, round_exact, title_case, unescaped
from tidewatch.operators import markets as m
from tidewatch.sources import catalogs, feeds, messages, store

NOW = 1_767_225_600_000  # 2026-01-01 UTC
ON, OFF = "2026-06-01T00:00:00Z", "2025-06-01T00:00:00+00:00"


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string")
    return [r.v for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_text_helpers(spark):
    assert values(spark, ["science & TECH", "pop-culture", "it's 3rd", None], title_case) == ["Science & Tech", "Pop-Culture", "It'S 3Rd", None]
    got = values(spark, ["2026-01-01T00:00:00Z", "2026-01-01T02:00:00+02:00", "2026-01-01", "2026-01-01T00:00:00", "soon", "", None], iso_millis)
    assert got == [NOW, NOW, NOW, NOW, None, None, None]


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.125, 0.0625), (0.375, -0.1875), (None, None)], "a double, b double")
    got = [tuple(r) for r in df.select(percent(F.col("a")), percent(F.col("b"), 1, signed=True), fixed(F.col("a") * 20)).collect()]
    assert got == [("12%", "+6.2%", "2"), ("38%", "-18.8%", "8"), (None, None, None)]


def test_categories(spark):
    got = values(spark, ["Will Trump win?", "BTC above 100k", "Fed rate cut", "Lakers over 100", "Rain in NYC", "Oscar winner", "NASA launch", "S&P close", "Nothing"],
                 lambda c: category_from_title(c, "kalshi"))
    assert got == ["Politics", "Cryptocurrency", "Economics", "Sports", "Weather", "Entertainment", "Science", "Business", "Other"]
    assert values(spark, [" elections - us ", "", None], lambda c: standard_category(c, F.lit("btc"), "kalshi")) == ["Elections - Us", "Cryptocurrency", "Cryptocurrency"]
    assert values(spark, ["Pop Culture", " Crypto", "pop culture", None], lambda c: standard_category(c, F.lit("x"), "polymarket")) == ["Entertainment", "Cryptocurrency", "Other", "Other"]


def test_prices(spark):
    none = F.lit(None).cast("string")
    assert values(spark, ["0.65", "65", "0", "bad", None], lambda c: kalshi_yes_price([c, none])) == [0.65, 0.65, None, None, None]
    got = values(spark, ['["0.7", "0.3"]', "[]", "oops", None], lambda c: polymarket_yes_price(c, none, F.lit("0.2"), F.lit("0.4")))
    assert got[0] == 0.7 and got[1:] == [pytest.approx(0.3)] * 3
    assert values(spark, [None], lambda c: polymarket_yes_price(c, none, F.lit("0.2"), none)) == [None]


def listing(**kw):
    return json.dumps({"ticker": "A-1", "title": "Will it rain?", "status": "active", "close_time": ON, "yes_ask_dollars": "0.40", **kw})


def test_kalshi_listing(rows):
    raw = rows.raw("kalshi", listing(volume_fp="0.00", volume=12), listing(volume_fp="", volume=0, open_interest=9, yes_sub_title="sub"),
                   listing(status="closed"), listing(close_time=OFF), listing(close_time="whenever"), listing(title=""), listing(ticker=None), "broken")
    got = catalogs.normalize_kalshi_listing(raw, NOW).collect()
    assert len(got) == 3 and [r.volume for r in got] == [0.0, 9.0, 0.0]
    assert got[0].category == "Weather" and got[0].no_price == pytest.approx(0.6) and got[1].description == "sub" and got[0].description == ""


def test_polymarket_listing_and_tokens(rows):
    def item(**kw):
        return json.dumps({"conditionId": "0xa", "question": "Bitcoin?", "active": True, "closed": False, "endDate": ON, "volume": 5.5,
                           "outcomePrices": '["0.65", "0.35"]', "clobTokenIds": '["t1", "t2"]', "description": "d" * 600, **kw})
    raw = rows.raw("polymarket", item(), item(closed=True, conditionId="0xb", clobTokenIds="bad"), item(active=None), item(endDate=OFF))
    r = catalogs.normalize_polymarket_listing(raw, NOW).collect()
    assert len(r) == 1 and (r[0].yes_price, r[0].volume, len(r[0].description), r[0].category) == (0.65, 5.5, 600, "Cryptocurrency")
    tokens = catalogs.token_map(raw)
    assert {(t.token_id, t.condition_id) for t in tokens.collect()} == {("t1", "0xa"), ("t2", "0xa")}
    assert catalogs.tickers_to_tokens(rows.markets(dict(external_id="0xa"), dict(external_id="0xz")), tokens).count() == 2


def test_event_metadata(rows, spark):
    snaps = catalogs.normalize_kalshi_listing(rows.raw("kalshi", listing(ticker="1", event_ticker="E1", subtitle="Outcome"),
                                                       listing(ticker="2", event_ticker="E2"), listing(ticker="3", event_ticker="E9")), NOW)
    dim = spark.createDataFrame([("E1", "climate", "Storms"), ("E2", "", "Group")], "event_ticker string, category string, title string")
    got = {r.external_id: r for r in catalogs.enrich_with_event_metadata(snaps, dim).collect()}
    assert (got["1"].title, got["1"].description, got["1"].category) == ("Outcome", "Storms", "Climate")
    assert (got["2"].title, got["2"].description, got["2"].category) == ("Will it rain?", "Group", "Weather")
    assert got["3"].description == ""


def test_taxonomy(spark):
    doc = json.dumps({"categories": [{"name": "pop stars", "tags": ["Singers", "crypto"]}, {"category": "Other", "tags": ["SINGERS"]}, {"tags": ["lost"]}]})
    tax = spark.createDataFrame([(1, doc)], "doc_id long, payload string")
    got = {(r.keyword, r.category) for r in catalogs.flatten_taxonomy(tax, catalogs.known_kalshi_categories(spark)).collect()}
    assert got == {("singers", "Pop Stars"), ("pop stars", "Pop Stars"), ("other", "Other")}


def kmsg(kind, **body):
    return json.dumps({"type": kind, "msg": body})


def test_kalshi_messages(rows):
    raw = rows.raw(
        "kalshi", kmsg("ticker", market_ticker="A", yes_ask_dollars="0.65", yes_bid_dollars="0.60", volume_fp="7"), kmsg("ticker", market_ticker="A"),
        kmsg("ticker", yes_ask_dollars="0.5"), kmsg("ticker", market_ticker="A", price_dollars="65"), kmsg("trade", market_ticker="A", yes_price_dollars="0.55", count=3, taker_side="yes"),
        kmsg("market_lifecycle", market_ticker="A", status="", result="yes"), kmsg("event_lifecycle", event_ticker="E"), kmsg("subscribed"), "{oops")
    got = messages.normalize_kalshi_messages(raw).collect()
    assert [(r.event_type, r.new_value) for r in got] == [("price_change", 0.65), ("price_change", 0.65), ("trade", 0.55), ("status_change", 0.0), ("status_change", 0.0)]
    docs = [json.loads(r.metadata) for r in got]
    assert docs[0] == {"ticker": "A", "yes_ask": "0.65", "yes_bid": "0.60", "volume": "7"}
    assert docs[2]["count"] == "3" and docs[3]["status"] == "yes" and docs[4]["lifecycle_type"] == "unknown" and docs[4]["market_ticker"] is None
    assert all(r.market_id == 0 and r.timestamp == 1000 for r in got)


def test_polymarket_messages(rows, spark):
    tokens = spark.createDataFrame([("t1", "0xa")], "token_id string, condition_id string")
    change = {"event_type": "price_change", "price_changes": [{"asset_id": "t1", "best_bid": "0.60", "best_ask": "0.62"}, {"asset_id": "t1", "price": "0.55"},
                                                              {"asset_id": "zz", "best_bid": "0.1"}, {"asset_id": "t1", "best_ask": "0.9"}, {"asset_id": "t1", "best_bid": "x"}]}
    raw = rows.raw("polymarket", json.dumps(change), json.dumps({"event_type": "last_trade_price", "asset_id": "t1", "price": "0.7", "size": "5", "side": "BUY"}),
                   json.dumps({"event_type": "last_trade_price", "asset_id": "zz", "price": "0.7"}), json.dumps({"type": "new_market", "market": "0xn"}), "PONG")
    got = sorted((r.event_type, round(r.new_value, 4), json.loads(r.metadata)["ticker"]) for r in messages.normalize_polymarket_messages(raw, tokens).collect())
    assert got == [("new_market", 0.0, "0xn"), ("price_change", 0.55, "0xa"), ("price_change", 0.61, "0xa"), ("trade", 0.7, "0xa")]
    assert messages.normalize_messages(raw, tokens).count() == 4


def _plan(df):
    """The operators of the plan that ran, with what they say."""
    df.collect()
    plans, out = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        else:
            out.append(plan.simpleString(100))
        children = plan.children().iterator()
        while children.hasNext():
            plans.append(children.next())
    return out


def _listed(spark, n):
    """Listings as JSON, of which Spark cannot tell how many tokens they hold."""
    item = F.to_json(F.struct(F.concat(F.lit("0x"), "id").alias("conditionId"), F.concat(F.lit('["t'), "id", F.lit('", "n'), "id", F.lit('"]')).alias("clobTokenIds")))
    return spark.range(n).select(F.lit(1).cast("long").alias("received_ms"), item.alias("payload"))


def _changes(rows, tokens):
    payload = json.dumps({"event_type": "price_change", "price_changes": [{"asset_id": t, "best_bid": "0.5"} for t in tokens]})
    return rows.raw("polymarket", payload, payload)


def test_tokens_do_not_pass_through_the_driver(rows, spark):
    tokens = catalogs.token_map(_listed(spark, 50))
    got = messages.normalize_polymarket_messages(_changes(rows, ["t7", "n49", "t50"]), tokens)
    ran = _plan(got)
    assert any(p.startswith("SortMergeJoin") for p in ran) and not any("Broadcast" in p for p in ran)
    assert sorted(json.loads(r.metadata)["ticker"] for r in got.collect()) == ["0x49", "0x49", "0x7", "0x7"]


def test_tokens_of_all_platforms_do_not_pass_through_the_driver(rows, spark):
    raw = _changes(rows, ["t7", "n49", "t50"]).unionByName(rows.raw("kalshi", kmsg("ticker", market_ticker="A", yes_ask_dollars="0.65"), kmsg("subscribed")))
    got = messages.normalize_messages(raw, catalogs.token_map(_listed(spark, 50)))
    ran = _plan(got)
    assert any(p.startswith("SortMergeJoin") for p in ran) and not any("Broadcast" in p for p in ran)
    assert sorted(json.loads(r.metadata)["ticker"] for r in got.collect()) == ["0x49", "0x49", "0x7", "0x7", "A"]


def test_a_hot_token_is_split(rows, spark):
    tokens = catalogs.token_map(_listed(spark, 50))
    raw = spark.range(0, 4000, 1, 4).crossJoin(_changes(rows, ["t7"]).limit(1)).unionByName(
        spark.range(0, 40, 1, 4).crossJoin(_changes(rows, [f"t{i}" for i in range(50)]).limit(1))).drop("id")
    options = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = messages.normalize_polymarket_messages(raw, tokens)
        assert any("skew=true" in p for p in _plan(got))
        assert got.count() == 4000 + 40 * 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_resolve(rows):
    ev = rows.events(dict(market_id=0, metadata='{"ticker": "A"}'), dict(market_id=0, metadata='{"ticker": "OLD"}'), dict(market_id=5), dict(market_id=0))
    mk = rows.markets(dict(id=3, external_id="A"), dict(id=4, external_id="OLD", is_active=False))
    assert sorted(r.market_id for r in messages.resolve_tickers(ev, mk).collect()) == [3, 5]


def test_markets_do_not_pass_through_the_driver(rows):
    ev = rows.events(*[dict(market_id=0, metadata=json.dumps({"ticker": f"T-{i % 7}"})) for i in range(20)], dict(market_id=9), dict(market_id=0, metadata="{}"))
    mk = rows.markets(*[dict(id=i, external_id=f"T-{i % 5}", is_active=i != 4) for i in range(5)], dict(id=8, external_id="T-1"))
    got = messages.resolve_tickers(ev, mk)
    ran = _plan(got)
    assert any(p.startswith("SortMergeJoin") for p in ran) and not any("Broadcast" in p for p in ran)
    assert got.columns == ev.columns
    assert sorted(r.market_id for r in got.collect()) == [0, 0, 0, 2, 2, 2, 3, 3, 3, 8, 8, 8, 9]


def test_orderbook(spark):
    def book(yes, no):
        return json.dumps({"orderbook": {"yes": yes, "no": no}})
    raw = spark.createDataFrame([("a", book([[0.4, 10], [0.45, 5]], [[0.5, 20]]), 1), ("b", book([[0.4, 10]], None), 1), ("c", book(None, [[0.3, 4]]), 1), ("d", book([], []), 1), ("e", "{}", 1)],
                                "ticker string, payload string, received_ms long")
    got = {r.ticker: r for r in feeds.orderbook_summary(raw).collect()}
    a = got["a"]
    assert (a.bid_depth, a.ask_depth, a.best_bid, a.best_ask, a.levels) == (15.0, 20.0, 0.45, 0.5, 3) and a.spread == pytest.approx(0.05)
    assert got["b"].best_ask == pytest.approx(0.42) and got["c"].best_bid == pytest.approx(0.68) and set(got) == {"a", "b", "c"}


def test_rss(spark):
    items = "".join(f"<item><title>T{i}</title></item>" for i in range(7))
    xml = ("<rss><channel><item><title>Bitcoin surges - past $100k - CoinDesk</title><link>http://l</link><pubDate>now</pubDate>"
           "<description>&lt;a href='x'&gt;Big&lt;/a&gt; &amp;amp; bold</description></item>" + items + "</channel></rss>")
    raw = spark.createDataFrame([(1, xml), (2, "not xml")], "feed_id long, payload string")
    got = feeds.rss_news_items(raw).orderBy("item_pos").collect()
    assert len(got) == 8 and (got[0].title, got[0].source, got[0].snippet) == ("Bitcoin surges - past $100k", "CoinDesk", "Big & bold")


def test_upsert_and_count(rows, spark):
    cur = rows.markets(dict(id=7, external_id="A", title="old", first_seen_at=5, yes_price=0.5), dict(id=8, external_id="B"))
    def snap(ext, title, ts):
        return ("kalshi", ext, title, "d", "c", True, 0.4, 0.6, 3.0, None, ts)
    inc = spark.createDataFrame([snap("A", "older", 1), snap("A", "new", 2), snap("N", "fresh", 1)], schemas.SNAPSHOTS)
    assert m.count_new(cur, inc).first()[0] == 1
    once = m.upsert_markets(cur, inc, 99)
    got = {r.external_id: r for r in once.collect()}
    assert (got["A"].id, got["A"].title, got["A"].first_seen_at, got["A"].last_updated_at, got["A"].yes_price) == (7, "new", 5, 99, 0.5)
    assert got["N"].first_seen_at == 99 and got["B"].last_updated_at == 0
    assert sorted(m.upsert_markets(once, inc, 99).collect(), key=str) == sorted(once.collect(), key=str)
    assert m.count_new(once, inc).first()[0] == 0


def test_deactivation(rows):
    mk = rows.markets(dict(id=1, external_id="a", last_updated_at=5), dict(id=2, external_id="b", end_date="2025-01-01", last_updated_at=50), dict(id=3, external_id="c", end_date="later", platform="polymarket"))
    def on(df):
        return {r.id for r in df.collect() if r.is_active}
    assert on(m.deactivate_stale(mk, "kalshi", 10)) == {2, 3} and on(m.deactivate_expired(mk, NOW)) == {1, 3}
    ev = rows.events(dict(event_type="status_change", market_id=1, metadata='{"status": "Settled"}'), dict(event_type="status_change", market_id=2, metadata='{"status": "active"}'),
                     dict(event_type="status_change", market_id=3, metadata='{"status": "closed", "source": "event_lifecycle_v2"}'))
    assert on(m.deactivate_terminal(mk, ev)) == {2, 3}


def test_latest_prices(rows):
    mk = rows.markets(dict(id=1, external_id="a", yes_price=0.1, price_updated_at=100), dict(id=2, external_id="b"), dict(id=3, external_id="c", yes_price=0.3, price_updated_at=100))
    ev = rows.events(dict(market_id=1, new_value=0.2, timestamp=101), dict(market_id=1, new_value=0.9, timestamp=101), dict(market_id=2, new_value=0.4, timestamp=1), dict(market_id=3, new_value=0.7, timestamp=100))
    once = m.apply_latest_prices(mk, ev)
    assert {r.id: r.yes_price for r in once.collect()} == {1: 0.2, 2: 0.4, 3: 0.3}
    ch = m.market_changes(ev)
    assert sorted(m.fold_market_changes(once, ch.unionByName(ch)).collect(), key=str) == sorted(once.collect(), key=str)


def snaps(spark, *rows_):
    return spark.createDataFrame([("kalshi", e, "T", None, "C", True, p, None, 0.0, None, ts) for e, p, ts in rows_], schemas.SNAPSHOTS)


DISCOVERY = [("A", 0.5, 1), ("A", 0.5, 2), ("A", 0.6, 3), ("A", None, 4), ("A", 0.7, 5), ("OFF", 0.5, 1), ("NEW", 0.5, 1), ("B", None, 1), ("B", 0.2, 90)]
DISCOVERED = [("new_market", None, 0.2, 90), ("new_market", None, 0.5, 1), ("new_market", None, 0.7, 5), ("price_change", None, 0.2, 90),
              ("price_change", None, 0.5, 1), ("price_change", None, 0.7, 5), ("price_change", 0.5, 0.6, 3)]


def shown(df):
    return sorted(((r.event_type, r.old_value, r.new_value, r.timestamp) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_discovery_events(rows, spark, chunk):
    mk = rows.markets(dict(id=1, external_id="A"), dict(id=2, external_id="B"), dict(id=3, external_id="OFF", is_active=False))
    assert shown(m.discovery_change_events(snaps(spark, *DISCOVERY), mk, chunk)) == sorted(DISCOVERED, key=str)
    seed = m.discovery_seed_events(snaps(spark, ("A", 0.5, 1), ("NEW", 0.5, 1), ("B", None, 1)), mk, 77).collect()
    assert [(r.market_id, r.new_value, r.timestamp) for r in seed] == [(1, 0.5, 77)] and "discovery_seed" in seed[0].metadata


def test_views(rows):
    mk = rows.markets(dict(id=1, external_id="G-1", title="Alpha", description="Group", yes_price=0.4, volume=99.0, price_updated_at=NOW - 7_200_000, end_date="2026-01-03T00:00:00Z", category="X"),
                      dict(id=2, external_id="G-2", title="beta", yes_price=0.9, volume=500.0), dict(id=3, external_id="H", is_active=False, yes_price=0.1))
    state = m.current_market_state(mk, NOW)
    import math
    got = {r.market_id: r.rank_score for r in state.collect()}
    assert got[1] == pytest.approx(0.4 * math.log(100) / 10 + 0.3 * 0.5 + 0.3 * 0.5) and set(got) == {1, 2}
    assert [r.market_id for r in m.market_search(state, sort="price").collect()] == [2, 1]
    assert [r.market_id for r in m.market_search(state, search="ALPH").collect()] == [1]
    assert [r.market_id for r in m.market_search(state, sort="volume", offset=1).collect()] == [1]
    groups = m.event_group_top_outcomes(mk, top=1).collect()
    assert {(r.event_key, r.market_id, r.group_size, r.group_title) for r in groups} == {("G", 2, 2, "Group"), ("H", 3, 1, "")}
    ev = rows.events(dict(market_id=1, timestamp=4), dict(market_id=1, timestamp=9))
    assert {r.market_id: r.event_count for r in m.market_summaries(mk, ev).collect()} == {1: 2, 2: 0, 3: 0}
    assert {r.id for r in m.purge_orphans(mk, ev).collect()} == {1, 2}
    stats = {(r.stat, r.name): r.n for r in m.market_stats(mk).collect()}
    assert stats[("total", "")] == 3 and stats[("active", "")] == 2 and stats[("category", "X")] == 1 and ("category", "") not in stats
    diff = {(r.external_id, r.change) for r in m.universe_diff(mk.filter("id < 3"), mk.filter("id > 1")).collect()}
    assert diff == {("G-1", "added"), ("H", "removed")}


def test_rekeyed_copy(rows):
    other = {"markets": rows.markets(dict(id=100, external_id="A"), dict(id=101, external_id="Z")), "events": rows.events(dict(market_id=100), dict(market_id=101)),
             "clusters": rows.clusters((1, "Fed")), "memberships": rows.memberships((100, 1, 0.9))}
    out = store.rekeyed_copy(other, rows.markets(dict(id=7, external_id="A")))
    ids = {r.external_id: r.id for r in out["markets"].collect()}
    assert ids["A"] == 7 and {r.market_id for r in out["events"].collect()} == set(ids.values())
    row = out["memberships"].first()
    assert row.market_id == 7 and row.cluster_id == out["clusters"].first().id


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_rounding_goes_by_the_binary_value(spark, digits):
    """Against literal values: what correct rounding of the stored number gives."""
    known = {2: [(2.675, 2.67), (0.125, 0.12), (0.375, 0.38), (-2.675, -2.67)], 4: [(0.12345, 0.1235), (0.00015, 0.0001), (0.00025, 0.0003)],
             0: [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0)], 1: [(0.25, 0.2), (0.35, 0.3), (0.45, 0.5)]}
    rng = random.Random(digits)
    many = [(rng.randint(-10**6, 10**6) * 10 + 5) / 10 ** (digits + 1) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in many + [x for x, _ in known[digits]]], "x double").select("x", round_exact(F.col("x"), digits).alias("r"))
    rows = {r.x: r.r for r in got.collect()}
    assert all(rows[x] == want for x, want in known[digits])
    assert all(rows[x] == round(x, digits) for x in many)


def test_exact_mean_of_ties(spark):
    for values, want in [((0.1234, 0.1235), 0.1234), ((0.1235, 0.1236), 0.1236), ((0.1, 0.2, 0.4), 0.2333), ((0.5,), 0.5)]:
        for parts in (1, 3):
            frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
            assert frame.agg(mean_exact(F.col("x"), 4)).first()[0] == want


def test_character_references(spark):
    texts = ["a &amp; b", "&lt;p&gt;&eacute;&#233;&#xE9;&#128;&bogus;&", "&#0;&#55296;&#1114112;", "plain", None, "&hellip;&nbsp;x"]
    assert values(spark, texts, unescaped) == ["a & b", "<p>éé\xe9€&bogus;&".replace("\\xe9", "é"), "\ufffd\ufffd\ufffd", "plain", None, "…\xa0x"]


def test_references_are_read_as_html_reads_them(spark):
    """With and without a closing semicolon, against the standard library."""
    chance = random.Random(1)
    names = list(html.entities.html5)
    bits = ["&amp", "&lt", "&ampx", "&notit;", "&copy2", "&#65", "&#x41;", "&#x4g", "&#0", "&#128;", "&#129", "&#1;", "&#xFFFE;", "&#99999999999999;", "&#xD800;",
            "&", "&&", "&;", "&#;", "&#x;", " a", "b;", "<", "&unknown;", "&frac12", "&there4;x", "&#00065;", "&#x0041"]
    texts = ["".join(chance.choice([*bits, "&" + chance.choice(names)]) for _ in range(chance.randint(0, 6))) for _ in range(1000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.u != html.unescape(r.t)] == [] and len(got) == 1000
