"""Streaming jobs against their batch operators, and the detection cycle."""

import dataclasses
import json
import random

from pyspark.sql import functions as F

from test_markets_feeds import DISCOVERED, DISCOVERY, shown, snaps
from tidewatch import schemas
from tidewatch.operators import candles as c
from tidewatch.operators import correlation
from tidewatch.operators import markets as m
from tidewatch.plans import cycle, publish
from tidewatch.sources import store
from tidewatch.streaming import alerts as sa
from tidewatch.streaming import candles as sc
from tidewatch.streaming import discovery as sd
from tidewatch.streaming import ingest, sources
from tidewatch.streaming import cycle as stream_cycle

MIN = 60_000
ONCE = {"availableNow": True}


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None
    query.stop()


def test_stream_candles_equal_batch(rows, spark, tmp_path):
    ev = rows.events(*[dict(id=i, market_id=i % 3, event_type="trade" if i % 4 == 0 else "price_change", new_value=(i % 17) / 10,
                            timestamp=i * 7000) for i in range(1, 200)])
    ev.filter("id < 100").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    ev.filter("id >= 100").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    # a late event moves the watermark past every minute
    rows.events(dict(id=999, market_id=9, new_value=0.5, timestamp=10**8)).write.parquet(str(tmp_path / "in/c"))
    stream = sc.stream_candles(sources.table_files(spark, str(tmp_path / "in"), schemas.EVENTS, 1), "10 minutes")
    root = str(tmp_path / "candles")
    finish(stream.writeStream.foreachBatch(lambda df, b: sc.append_batch(df, b, root)).option("checkpointLocation", str(tmp_path / "cp"))
           .outputMode("append").trigger(**ONCE).start())
    got = spark.read.parquet(root).drop("created_at", "ingest_batch")
    want = c.minute_candles(ev, 10**8).drop("created_at")
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and want.count() > 20


def test_late_rows_are_brought_into_the_bars(rows, spark, tmp_path):
    first = [dict(id=i, market_id=1, new_value=i / 100, timestamp=i * 20_000) for i in range(1, 40)]
    late = [dict(id=100, market_id=1, new_value=0.9, timestamp=60_001), dict(id=101, market_id=1, new_value=0.001, timestamp=59_999),
            dict(id=102, market_id=1, event_type="trade", new_value=7.0, timestamp=130_000), dict(id=103, market_id=2, new_value=0.4, timestamp=5),
            dict(id=104, market_id=1, new_value=0.95, timestamp=60_000 - 60_000)]
    for i, part in enumerate((first, [dict(id=99, market_id=9, new_value=0.5, timestamp=10**8)], late)):
        rows.events(*part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    root = str(tmp_path / "candles")
    for i in (1, 2, 3):  # one run a file, so that the watermark has passed before the late rows come
        names = str(tmp_path / "in") + "/{" + ",".join(map(str, range(i))) + "}"
        stream = sc.stream_candles(spark.readStream.schema(schemas.EVENTS).parquet(names), "1 minute")
        finish(stream.writeStream.foreachBatch(lambda df, b: sc.append_batch(df, b, root)).option("checkpointLocation", str(tmp_path / "cp"))
               .outputMode("append").trigger(**ONCE).start())
    stored, log = spark.read.parquet(root).drop("ingest_batch"), rows.events(*first, *late)
    want = sorted(c.minute_candles(log, 10**7).drop("created_at").collect())
    assert sorted(stored.drop("created_at").select(want[0].__fields__).collect()) != want
    for arrived in (rows.events(*late), log):
        got = sc.repaired_candles(stored, log, arrived, 10**7)
        assert got.columns == stored.columns
        assert sorted(got.drop("created_at").select(want[0].__fields__).collect()) == want


def test_late_rows_change_their_bars_by_themselves(rows, spark, tmp_path):
    """Rows of any age and order over many batches; bars are those of all rows at once, before and after folding."""
    chance = random.Random(8)
    made = [dict(id=i, market_id=i % 4, event_type=("price_change", "trade", "volume_update")[i % 7 % 3], new_value=chance.randrange(0, 50) / 10,
                 timestamp=chance.randrange(0, 3 * 86_400_000, 20_000)) for i in range(1, 300)]
    for n in range(3):
        rows.events(*made[n * 70:(n + 1) * 70]).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    src = sources.table_files(spark, str(tmp_path / "in"), schemas.EVENTS, 1)
    root, now = str(tmp_path / "bars"), 10**9

    def bars(frame):
        return sorted(map(tuple, frame.drop("created_at").collect()))

    finish(sc.start_bars(src, root, str(tmp_path / "cp"), ONCE))
    assert bars(sc.read_bars(spark, root, now)) == bars(c.minute_candles(rows.events(*made[:210]), now))
    assert len(sc.fold_bars(spark, root).folders) == 3
    # the rest are late for every market
    rows.events(*made[210:]).coalesce(1).write.parquet(str(tmp_path / "in/3"))
    finish(sc.start_bars(src, root, str(tmp_path / "cp"), ONCE))
    want = bars(c.minute_candles(rows.events(*made), now))
    assert bars(sc.read_bars(spark, root, now)) == want and len(want) > 100
    sc.bars_batch(rows.events(*made[210:]), 3, root)  # delivered again
    assert len(sc.fold_bars(spark, root).folders) == 3 and bars(sc.read_bars(spark, root, now)) == want
    since = 2 * 86_400_000
    assert bars(sc.read_bars(spark, root, now, since)) == [b for b in want if b[2] >= since]
    assert sc.read_bars(spark, str(tmp_path / "none"), now).count() == 0


def test_ingest_stream(rows, spark, tmp_path):
    msgs = [("kalshi", json.dumps({"type": "ticker", "msg": {"market_ticker": "A", "yes_ask_dollars": p}}), t) for p, t in (("0.40", 1), ("0.70", 3), ("0.60", 2))]
    msgs += [("kalshi", json.dumps({"type": "market_lifecycle", "msg": {"market_ticker": "B", "status": "settled"}}), 4),
             ("kalshi", json.dumps({"type": "ticker", "msg": {"market_ticker": "UNKNOWN", "yes_ask_dollars": "0.4"}}), 5), ("kalshi", "junk", 6)]
    spark.createDataFrame(msgs, schemas.RAW_MESSAGES).coalesce(1).write.json(str(tmp_path / "raw"))
    mk = rows.markets(dict(id=1, external_id="A"), dict(id=2, external_id="B"))
    store.write_markets(mk, str(tmp_path / "markets"), 0)
    tokens = spark.createDataFrame([], "token_id string, condition_id string")
    out = str(tmp_path / "out")
    finish(ingest.start_ingest(sources.message_files(spark, str(tmp_path / "raw")), tokens, str(tmp_path / "markets"), out, str(tmp_path / "cp"), trigger=ONCE))
    log = store.read_events(spark, f"{out}/events")
    assert sorted((r.market_id, r.event_type, r.timestamp) for r in log.collect()) == [(1, "price_change", 1), (1, "price_change", 2), (1, "price_change", 3), (2, "status_change", 4)]
    changes = spark.read.parquet(f"{out}/market_changes").drop("ingest_batch")
    got = {r.id: r for r in m.fold_market_changes(mk, changes).collect()}
    assert (got[1].yes_price, got[1].price_updated_at, got[2].is_active) == (0.7, 3, False)
    # the same batch again changes nothing
    ingest.ingest_batch(spark.createDataFrame(msgs, schemas.RAW_MESSAGES), 0, tokens, str(tmp_path / "markets"), out)
    assert store.read_events(spark, f"{out}/events").count() == 4


def test_stream_discovery_equals_batch(rows, spark, tmp_path):
    mk = rows.markets(dict(id=1, external_id="A"), dict(id=2, external_id="B"), dict(id=3, external_id="OFF", is_active=False))
    for i, part in enumerate((DISCOVERY[:2], DISCOVERY[2:])):
        snaps(spark, *part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    src = sources.table_files(spark, str(tmp_path / "in"), schemas.SNAPSHOTS, 1)
    out = str(tmp_path / "out")
    finish(sd.start_discovery(src, mk, out, str(tmp_path / "cp"), 2, ONCE))
    assert shown(spark.read.parquet(f"{out}/events").drop("batch")) == sorted(DISCOVERED, key=str)


def test_discovery_batches_rewrite_touched_buckets_only(rows, spark, tmp_path):
    """Many markets over four batches, one of them run twice: events as of all snapshots at once."""
    mk = rows.markets(*[dict(id=i, external_id=f"M{i}") for i in range(40)])
    polls = [[(f"M{i}", None if (i + n) % 7 == 0 else (i * n % 5) / 10, n) for i in some] for n, some in enumerate(([*range(40)], [3, 4], [*range(0, 40, 2)], [5]))]
    made = [spark.createDataFrame([("kalshi", x, x, "t", None, p, 1000 * n) for x, p, n in poll],
                                  "platform string, external_id string, title string, description string, category string, yes_price double, snapshot_ts long")
            for poll in polls]
    out = str(tmp_path)
    for n in (0, 1, 2, 2, 3):
        sd.discover_batch(made[n], n, mk, out, 8)
    every = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    assert shown(spark.read.parquet(f"{out}/events").drop("batch")) == shown(m.discovery_change_events(every, mk))
    assert len(list((tmp_path / "last_prices/batch=3").glob("bucket=*"))) == 1
    last = {r.market_id: r.yes_price for r in sd.last_prices(spark, f"{out}/last_prices", 4).collect()}
    assert last == {int(x[1:]): p for poll in polls for x, p, _ in poll}


def test_alert_stream_delivers_once_and_throttles(spark, tmp_path):
    schema = "anomaly_id long, severity double, detected_at long, summary string, cluster_name string, catalyst_type string, platform string, headline string"
    def feed(*ids):
        return spark.createDataFrame([(i, 0.5, i, f"s{i}", None, None, None, None) for i in ids], schema)
    feed(1, 2, 3).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    feed(2, 3, *range(4, 15)).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    users = spark.createDataFrame([("u", [], [], True, False)], schemas.USERS)
    src = sources.table_files(spark, str(tmp_path / "in"), feed(1).schema, 1)
    root = str(tmp_path / "alerts")
    finish(sa.start_alerts(src, users, root, str(tmp_path / "cp"), lambda: 1_000_000, ONCE))
    got = spark.read.parquet(root)
    ids = sorted(r.anomaly_id for r in got.collect())
    # 10 in the hour; the second batch gives its newest ones for the places left
    assert len(ids) == 10 and len(set(ids)) == 10
    assert got.groupBy("user_id").count().first()["count"] == 10


def test_alert_state_does_not_grow_over_the_hours(spark, tmp_path):
    """Ten anomalies an hour for six days; ids are remembered for a day behind the watermark, only two hours of alerts are read."""
    schema = "anomaly_id long, severity double, detected_at long, summary string, cluster_name string, catalyst_type string, platform string, headline string"
    hour = 3_600_000
    users = spark.createDataFrame([("u", [], [], True, False)], schemas.USERS)
    (tmp_path / "in").mkdir()
    src = sources.table_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    root, held = str(tmp_path / "alerts"), []
    for step, hours in enumerate((range(0, 48), range(48, 72), range(72, 96), range(96, 120), range(120, 144))):
        # in each part the hours of a day, then the first of them again
        ids = [(h * 10 + i, 0.5, h * hour + i, f"s{h}", None, None, None, None) for h in hours for i in range(10)]
        spark.createDataFrame(ids + ids[-20:], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{step}"))
        spark.createDataFrame(ids[-10:], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{step}again"))
        query = sa.start_alerts(src, users, root, str(tmp_path / "cp"), lambda h=hours[-1]: h * hour + 1, ONCE)
        finish(query)
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert max(held) <= 3 * 24 * 10 and held[-1] <= held[-2] <= held[-3]
    got = spark.read.parquet(root)
    assert {r.hour for r in got.select("hour").distinct().collect()} == {47, 71, 95, 119, 143}
    assert got.count() == 50 and got.select("anomaly_id").distinct().count() == 50
    # the hour before counts against the limit, older ones do not
    assert sa.sent_lately(spark, root, 10**6, 144 * hour).count() == 10 and sa.sent_lately(spark, root, 10**6, 146 * hour).count() == 0


def test_an_alert_batch_that_broke_off_is_replaced(spark, tmp_path):
    schema = "anomaly_id long, severity double, detected_at long, summary string, cluster_name string, catalyst_type string, platform string, headline string"
    feed = spark.createDataFrame([(1, 0.5, 1, "s", None, None, None, None)], schema)
    users = spark.createDataFrame([("u", [], [], True, False)], schemas.USERS)
    for now in (3_599_999, 3_600_001):
        sa.alert_batch(feed, 4, users, str(tmp_path), now)
    got = spark.read.parquet(str(tmp_path)).collect()
    assert [(r.anomaly_id, r.hour, r.batch) for r in got] == [(1, 1, 4)]


def small_world(rows, now):
    price = [dict(market_id=i, new_value=v, timestamp=now - ago) for i in (1, 2, 3, 4) for v, ago in ((0.50, 20 * MIN), (0.50, 4 * MIN), (0.80, 2 * MIN))]
    mk = rows.markets(*[dict(id=i, external_id=f"BTC-{i}", platform="kalshi" if i % 2 else "polymarket", title=f"price of BTC {i}", yes_price=0.5) for i in (1, 2, 3, 4)])
    return cycle.Tables(
        events=rows.events(*price), markets=mk, anomalies=rows.anomalies(dict(id=5, detected_at=now - 30 * 3_600_000)).limit(1),
        anomaly_markets=rows.links(dict(anomaly_id=5, market_id=1)), clusters=rows.clusters((1, "Coins")),
        memberships=rows.memberships((1, 1, 0.9), (2, 1, 0.8), (3, 1, 0.7)), links=rows.pairs((3, 4, 0.95)),
    )


def test_cycle(rows, spark, tmp_path):
    now = 100 * 3_600_000
    t = small_world(rows, now)
    r = cycle.detection_cycle(t, now)
    counts = {x.stage: x.found for x in cycle.cycle_counts(r).collect()}
    # 3-4 is a stored link; 1-2 and 2-3 share a cluster on two platforms
    assert counts == {"single": 4, "cluster": 1, "series": 1, "cross_platform": 3}
    by_id = {x.id: x for x in r.anomalies.collect()}
    assert by_id[5].status == "expired" and len(by_id) == 10
    single = [x for x in by_id.values() if x.anomaly_type == "single_market" and x.id != 5]
    assert all("template_narrative" in json.loads(x.metadata) for x in single)
    assert r.anomaly_markets.count() == 1 + 4 + 3 + 4 + 2 * 3
    store.write_anomalies(r.anomalies, r.anomaly_markets, str(tmp_path), 1)
    again = cycle.detection_cycle(
        cycle.Tables(t.events, t.markets, store.read_snapshot(spark, str(tmp_path / "anomalies")),
                     store.read_snapshot(spark, str(tmp_path / "anomaly_markets")), t.clusters, t.memberships, t.links), now + 1)
    assert again.new_anomalies.count() == 0
    serving = publish.serving_tables(cycle.Tables(t.events, t.markets, r.anomalies, r.anomaly_markets, t.clusters, t.memberships, t.links), now)
    publish.publish(serving, str(tmp_path / "serving"), 1)
    assert {n: store.read_snapshot(spark, str(tmp_path / "serving" / n)).count() for n in serving} == {"markets": 4, "anomalies": 9, "topics": 1, "summaries": 4}


def test_cycle_links_asked_pairs(rows):
    now = 100 * 3_600_000
    t = small_world(rows, now)
    # 2-1 share a cluster on two platforms, 1-3 are on one, 4 is in no cluster, 3-4 is stored
    asked = rows.pairs((2, 1, 0.1), (1, 3, 0.1), (1, 4, 0.1), (3, 4, 0.1)).select("market_id_a", "market_id_b")
    found = cycle.detection_cycle(dataclasses.replace(t, asked=asked), now).stages["cross_platform"].collect()
    assert {(r.market_id_a, r.market_id_b, json.loads(r.metadata)["link_confidence"]) for r in found} == {(1, 2, 0.8), (2, 3, 0.7), (3, 4, 0.95)}
    assert len(found) == 3


def test_cycle_finds_links_of_a_cluster_without_pairs(rows, spark):
    """Neither stored nor asked pairs: each anomalous member with its best partner on another platform."""
    now = 100 * 3_600_000
    t = dataclasses.replace(small_world(rows, now), links=rows.pairs())
    found = cycle.detection_cycle(t, now).stages["cross_platform"].collect()
    assert {(r.market_id_a, r.market_id_b) for r in found} == {(1, 2), (2, 3)}
    # one platform only: no links
    alone = dataclasses.replace(t, markets=t.markets.withColumn("platform", F.lit("kalshi")))
    assert cycle.detection_cycle(alone, now).stages["cross_platform"].count() == 0


def test_best_partners_are_those_of_all_pairs(rows):
    """Against all pairs of members; the number of links counts each cluster."""
    now = 10**9
    an = rows.anomalies(*[dict(id=i, severity=(i * 7 % 5) / 10, detected_at=now) for i in range(1, 25)], dict(id=99, status="expired", detected_at=now))
    li = rows.links(*[dict(anomaly_id=i, market_id=i) for i in range(1, 25)], dict(anomaly_id=99, market_id=30))
    mk = rows.markets(*[dict(id=i, external_id=f"T{i}", platform=("kalshi", "polymarket", "other")[i % 3], is_active=i != 4) for i in range(1, 31)])
    me = [(i, c) for i in range(1, 31) for c in {i % 4, i % 3 + 10 * (i > 20), 7}]
    got = {r.market_id: (r.partner_id, r.n_links) for r in
           correlation.anomalous_partners(an, li, rows.memberships(*[(i, c, 0.5) for i, c in me]), mk, now).collect()}
    live = [(i, c) for i, c in me if i < 25 and i != 4]
    pairs = [(i, j) for i, c in live for j, d in live if c == d and i % 3 != j % 3]
    assert got == {i: (max((j for k, j in pairs if k == i), key=lambda j: ((j * 7 % 5) / 10, -j)), sum(k == i for k, _ in pairs)) for i, _ in pairs}


def test_quiet_cycle_only_expires(rows):
    now = 100 * 3_600_000
    t = small_world(rows, now)
    r = cycle.detection_cycle(t, now + 3 * 3_600_000)
    assert r.new_anomalies.count() == 0 and r.anomalies.first().status == "expired"


def test_scheduled_cycle(rows, spark, tmp_path):
    now = 100 * 3_600_000
    t = small_world(rows, now)
    log = str(tmp_path / "log")
    store.append_events(t.events, log, 0)
    store.append_events(rows.events(*[dict(id=900 + i, timestamp=now - i * 43_200_000) for i in range(5)]), log, 1)
    config = cycle.CycleConfig(retention_days=1)
    stream_cycle.cycle_batch(0, t, now, str(tmp_path), config, log)
    assert store.read_snapshot(spark, str(tmp_path / "anomalies")).filter(F.col("status") == "active").count() == 9
    # rows older than a day are gone, and so are the folders of whole days at the next version
    assert sorted(r.id for r in store.read_events(spark, log).collect() if r.id >= 900) == [900, 901, 902]
    stream_cycle.cycle_batch(1, t, now, str(tmp_path), config, log, compact_every=2)
    left = sorted({p.name for p in (tmp_path / "log").glob("ingest_batch=*/event_date=*")})
    assert left == ["event_date=1970-01-04", "event_date=1970-01-05"]
    assert sorted(r.id for r in store.read_events(spark, log).collect() if r.id >= 900) == [900, 901, 902]
