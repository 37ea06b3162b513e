"""Event log checks, retention, activity and candles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import activity as act
from tidewatch.operators import candles as c
from tidewatch.operators import quality as q
from tidewatch.sources import manifest, messages, store, upkeep

MIN = 60_000


def at(rows, *times):
    return rows.events(*[dict(timestamp=t) for t in times])


def test_counts(rows):
    r = q.store_counts(rows.markets(dict()), at(rows, 1000, 2000, 3000), 1500, 2500).collect()[0]
    assert (r.market_count, r.event_count, r.min_ts, r.max_ts, r.in_range) == (1, 3, 1000, 3000, 1)
    empty = q.store_counts(rows.markets(), rows.events(), 0, 1).collect()[0]
    assert empty.min_ts is None and empty.event_count == 0


def test_duplicates(rows):
    ev = at(rows, 10, 10, 10, 20)
    assert q.duplicate_events(ev).first()[0] == 2
    assert q.duplicate_events(ev, since_ms=15).first()[0] == 0


def test_gaps(rows):
    assert q.event_gaps(at(rows, 0, 200_000)).count() == 0
    r = q.event_gaps(at(rows, 1000, 601_000)).collect()
    assert [(x.start_ts, x.end_ts, x.duration_ms) for x in r] == [(1000, 601_000, 600_000)]
    assert q.event_gaps(at(rows, 0, 300_000)).count() == 1  # a gap of exactly the threshold


@pytest.mark.parametrize("threshold", [1, 7, 1000])
def test_gaps_equal_brute_force(rows, threshold):
    rng = random.Random(threshold)
    times = [rng.randrange(0, 400_000_000) for _ in range(200)] + [5, 5, 6]
    ordered = sorted(times)
    want = {(a, b) for a, b in zip(ordered, ordered[1:]) if b - a >= threshold}
    got = q.event_gaps(at(rows, *times), threshold).collect()
    assert len(got) == len(want) and {(r.start_ts, r.end_ts) for r in got} == want


def test_ordering_violations_across_blocks(rows):
    ev = rows.events(dict(id=1, timestamp=3000), dict(id=2, timestamp=1000))
    assert q.ordering_violations(ev).first()[0] == 1
    edge = rows.events(dict(id=4095, timestamp=9), dict(id=4096, timestamp=8), dict(id=4098, timestamp=1))
    assert q.ordering_violations(edge).first()[0] == 1
    assert q.ordering_violations(edge, since_ms=9).first()[0] == 0


def test_integrity_gate(rows):
    rep = {r.check_name: r for r in q.integrity_report(at(rows, 0, 80 * 3_600_000)).collect()}
    assert rep["duration_hours"].status == "PASS" and rep["total_events"].status == "WARN"
    assert rep["gate"].status == "NOT MET" and rep["gaps"].value == 1.0


def test_recent_buffer_is_exact_for_a_hot_market(rows):
    ev = at(rows, *range(1, 301)).unionByName(rows.events(dict(id=1000, market_id=2, timestamp=7)))
    got = q.recent_buffer(ev, 300, max_age_ms=299, per_market=50)
    hot = sorted(r.timestamp for r in got.filter("market_id = 1").collect())
    assert hot == list(range(251, 301)) and got.filter("market_id = 2").count() == 1
    assert q.latest_event(ev).filter("market_id = 1").first().timestamp == 300


def test_retention(rows):
    ev = at(rows, 1, 5, 9)
    assert q.prune_events(ev, 5).count() == 2 and q.prune_preview(ev, 5).first()[0] == 1
    assert q.retention_cutoff(10 * 86_400_000, 0) is None and q.retention_cutoff(10 * 86_400_000, 3) == 7 * 86_400_000
    assert q.purge_by_type(ev, "price_change", 6).count() == 1


def test_hourly_activity(rows):
    # 2026-01-04 02:30 UTC is Saturday 21:30 in New York
    ts = 1_767_493_800_000
    ev = rows.events(
        dict(timestamp=ts, new_value=0.6, old_value=0.5), dict(timestamp=ts + 1, new_value=0.6, market_id=2),
        dict(timestamp=ts + 2, event_type="trade"), dict(timestamp=ts - 8 * 86_400_000), dict(timestamp=ts, market_id=99),
    )
    m = rows.markets(dict(id=1, category="A"), dict(id=2, category="A", external_id="T-2"))
    got = {r.event_type: r for r in act.hourly_activity(ev, m, ts + 10).collect()}
    p = got["price_change"]
    assert (p.hour_et, p.day_of_week, p.event_count, p.active_markets) == (21, 6, 2, 2)
    assert p.avg_price_delta == pytest.approx(0.05) and got["trade"].trade_count == 1
    hourly = act.hourly_activity(ev, m, ts + 10)
    hours = {r.hour_et: r for r in act.peak_hours(hourly).collect()}
    assert len(hours) == 24 and hours[21].bar == 1.0 and hours[3].avg_events == 0.0
    assert act.weekday_weekend(hourly).first().period == "weekend"
    assert act.category_activity(hourly).first().avg_markets == pytest.approx(1.5)  # distinct counts 2 and 1


def test_minute_candle(rows):
    ev = rows.events(
        *[dict(new_value=p, timestamp=MIN + i) for i, p in enumerate((0.50, 0.70, 0.45, 0.60))],
        dict(event_type="trade", new_value=15.0, timestamp=MIN + 5), dict(event_type="trade", new_value=25.9, timestamp=MIN + 6),
        dict(new_value=0.0, timestamp=MIN + 7), dict(event_type="trade", new_value=1.0, timestamp=2 * MIN + 1),
        dict(new_value=0.9, timestamp=3 * MIN + 1),
    )
    r = c.minute_candles(ev, 3 * MIN + 30_000).collect()
    assert len(r) == 1  # a minute without a price and the running minute give no bar
    b = r[0]
    assert (b.open, b.high, b.low, b.close, b.volume, b.trade_count, b.open_ts) == (0.50, 0.70, 0.45, 0.60, 40, 2, MIN)


def test_ohlcv_one_bar_on_tied_times(rows):
    ev = rows.events(dict(new_value=0.5, timestamp=10), dict(new_value=0.6, timestamp=10),
                     dict(event_type="volume_update", new_value=7.0, timestamp=11), dict(event_type="trade", new_value=0.25, timestamp=12))
    b = c.candles_ohlcv(ev, 3_600_000).collect()
    assert len(b) == 1 and (b[0].open, b[0].close, b[0].volume, b[0].time) == (0.5, 0.6, 7.25, 0)


def test_merge_candles_is_idempotent(rows, spark):
    def bars(*r):
        return spark.createDataFrame([(m, "1m", o, o + MIN, *p, v, n, 1) for m, o, p, v, n in r],
                                     "market_id long, interval string, open_ts long, close_ts long, open double, high double, low double, close double, volume long, trade_count int, created_at long")
    old = bars((1, 0, (0.5, 0.6, 0.4, 0.5), 10, 1))
    new = bars((1, 0, (0.9, 0.7, 0.45, 0.65), 12, 2), (2, 0, (0.1, 0.1, 0.1, 0.1), 1, 1))
    once = c.merge_candles(old, new)
    r = once.filter("market_id = 1").first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.trade_count) == (0.5, 0.7, 0.4, 0.65, 12, 2)
    assert sorted(c.merge_candles(once, new).collect()) == sorted(once.collect())


def test_best_source(rows, spark):
    stored = c.minute_candles(rows.prices((0.5, 10), (0.6, MIN + 10)), 10 * MIN)
    computed = c.candles_ohlcv(rows.prices((0.1, 10)).unionByName(rows.prices((0.2, 10), market_id=2)), 3_600_000)
    external = spark.createDataFrame([(1, 60, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 60, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                     "market_id long, time long, open double, high double, low double, close double, volume double")
    got = {(r.market_id, r.time): (r.source, r.open, r.close) for r in c.best_source_candles(stored, computed, external).collect()}
    assert got == {(1, 0): ("stored", 0.5, 0.6), (2, 0): ("computed", 0.2, 0.2), (3, 60_000): ("external", 1.0, 1.0)}
    assert {r.direction for r in c.chart_series(computed.withColumn("time", F.lit(5))).collect()} == {"up"}


def test_store_round_trip(rows, spark, tmp_path):
    day = 86_400_000
    ev = rows.events(dict(event_type="trade", timestamp=day), dict(timestamp=day), dict(event_type="trade", timestamp=3 * day))
    root = str(tmp_path / "events")
    store.append_events(ev, root, 0, persist_price_change=False)
    store.append_events(ev, root, 0, persist_price_change=False)  # a retried batch replaces itself
    store.append_events(ev.filter("timestamp < 100000000"), root, 1)
    assert store.read_events(spark, root).count() == 4
    since = store.read_events(spark, root, since_ms=2 * day)
    assert since.count() == 1
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan


def test_rows_without_ids_get_running_ones_in_order_of_arrival(rows, spark, tmp_path):
    ev = at(rows, *[5, 4, 9, 8, 7, 10, 1]).repartition(3).drop("id")
    arrived = [r.timestamp for r in ev.collect()]
    store.append_events(ev, str(tmp_path / "log"), 3)
    log = store.read_events(spark, str(tmp_path / "log")).orderBy("id").collect()
    assert [r.id for r in log] == [(3 << store.BATCH_BITS) + i for i in range(7)] and [r.timestamp for r in log] == arrived
    late = sum(b < a for a, b in zip(arrived, arrived[1:]))
    assert q.ordering_violations(store.read_events(spark, str(tmp_path / "log"))).first()[0] == late


def test_snapshot_versions(rows, spark, tmp_path):
    root = str(tmp_path / "markets")
    assert store.read_snapshot(spark, root) is None
    for version in (0, 2, 10):
        store.write_snapshot(rows.markets(dict(id=version)), root, version)
    assert store.latest_version(spark, root) == 10 and store.read_snapshot(spark, root).first().id == 10
    assert store.read_snapshot(spark, root, 2).first().id == 2


def test_enums_are_checked_on_write(rows, tmp_path):
    with pytest.raises(Exception, match="bad platform: mars"):
        store.write_markets(rows.markets(dict(platform="mars")), str(tmp_path / "m"), 0)
    with pytest.raises(Exception, match="bad status"):
        store.write_anomalies(rows.anomalies(dict(status="odd")), rows.links(), str(tmp_path / "a"), 0)


def test_archive_and_csv(rows, spark, tmp_path):
    store.archive_events(at(rows, 3_600_000, 2 * 3_600_000, 90_000_000), str(tmp_path / "a"))
    back = spark.read.json(str(tmp_path / "a"))
    assert sorted((str(r.date), r.hour) for r in back.collect()) == [("1970-01-01", 1), ("1970-01-01", 2), ("1970-01-02", 1)]
    store.write_csv(spark.createDataFrame([(1, 'say "x", y')], "id long, t string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().t == 'say "x", y'


# --- the log's manifest: retention and compaction ---------------------------------------------


def _batches(spark, rows, root, n, per=4):
    made = []
    for batch in range(n):
        part = [dict(market_id=i, event_type="trade", new_value=1.0, timestamp=day * 86_400_000 + batch * 1000 + i) for day in (1, 2, 3) for i in range(per)]
        store.append_events(rows.events(*part).drop("id"), root, batch)
        made += [(d["market_id"], d["timestamp"]) for d in part]
    return sorted(made)


def _read(spark, root):
    return sorted((r.market_id, r.timestamp) for r in store.read_events(spark, root).collect())


def _data_files(root):
    return sorted(str(p.relative_to(root)) for p in root.glob("ingest_batch=*/event_date=*/part-*.parquet"))


def test_many_small_batches_become_a_few_files(spark, rows, tmp_path):
    made = _batches(spark, rows, str(tmp_path), 12)
    before = store.read_events(spark, str(tmp_path))
    first = upkeep.compact(spark, str(tmp_path))
    assert _read(spark, str(tmp_path)) == made and len(first.folders) == 3 and first.upto == 11
    assert sum(f.parts for f in first.folders) == 3
    # a reader that began before still finds its files; the next version lets them go
    assert sorted((r.market_id, r.timestamp) for r in before.collect()) == made
    store.append_events(rows.events(dict(market_id=7, event_type="trade", timestamp=5)).drop("id"), str(tmp_path), 12)
    second = upkeep.compact(spark, str(tmp_path))
    assert _read(spark, str(tmp_path)) == sorted([*made, (7, 5)]) and second.version == 2
    assert len(_data_files(tmp_path)) == 4
    ids = [r.id for r in store.read_events(spark, str(tmp_path)).collect()]
    assert len(set(ids)) == len(made) + 1


def test_compaction_while_a_batch_is_written(spark, rows, tmp_path):
    made = _batches(spark, rows, str(tmp_path), 4)
    (tmp_path / "ingest_batch=2" / "_SUCCESS").unlink()
    half = [x for x in made if x[1] % 86_400_000 // 1000 != 2]
    assert _read(spark, str(tmp_path)) == half
    log = upkeep.compact(spark, str(tmp_path))
    assert log.upto == 1 and _read(spark, str(tmp_path)) == half
    (tmp_path / "ingest_batch=2" / "_SUCCESS").touch()
    assert _read(spark, str(tmp_path)) == made
    assert upkeep.compact(spark, str(tmp_path)).upto == 3 and _read(spark, str(tmp_path)) == made
    # a batch that is delivered again changes nothing
    store.append_events(rows.events(dict(market_id=0, event_type="trade", timestamp=1)).drop("id"), str(tmp_path), 3)
    assert _read(spark, str(tmp_path)) == made


def test_whole_days_leave_and_one_day_is_cut(spark, rows, tmp_path):
    made = _batches(spark, rows, str(tmp_path), 3)
    cutoff = 2 * 86_400_000 + 1000
    want = [x for x in made if x[1] >= cutoff]
    upkeep.prune(spark, str(tmp_path), cutoff, rewrite=False)
    assert _read(spark, str(tmp_path)) == want
    log = upkeep.prune(spark, str(tmp_path), cutoff)
    assert _read(spark, str(tmp_path)) == want and {f.day for f in log.folders} == {"1970-01-03", "1970-01-04"}
    assert not list(tmp_path.glob("ingest_batch=*/event_date=1970-01-02"))
    upkeep.compact(spark, str(tmp_path))
    upkeep.compact(spark, str(tmp_path))
    assert _read(spark, str(tmp_path)) == want and len(_data_files(tmp_path)) == 2
    # an older cutoff brings nothing back
    assert upkeep.prune(spark, str(tmp_path), 0).floor_ms == cutoff and _read(spark, str(tmp_path)) == want
    upkeep.prune(spark, str(tmp_path), 10**12)
    assert _read(spark, str(tmp_path)) == []


def test_upkeep_of_an_empty_log(spark, tmp_path):
    assert upkeep.compact(spark, str(tmp_path / "none")).folders == ()
    assert store.read_events(spark, str(tmp_path / "none")).count() == 0


def test_folders_are_packed_first_fit_decreasing():
    folders = [manifest.Folder(f"ingest_batch={i}/event_date=d", "d", s, 1) for i, s in enumerate([10, 60, 50, 40, 30, 10])]
    assert [sum(f.size for f in held) for held in upkeep.packed(folders, 100)] == [100, 100]


def test_a_version_is_published_once(spark, tmp_path):
    manifest.publish(spark, str(tmp_path), manifest.Manifest(), [], None)
    with pytest.raises(FileExistsError):
        manifest.publish(spark, str(tmp_path), manifest.Manifest(), [], None)


# --- arrival numbers --------------------------------------------------------------------------


def test_ids_follow_arrival_whatever_the_joins_do(spark, rows, tmp_path):
    """Three source partitions, rows dealt anew by a shuffled join; a message with two updates."""
    part = [dict(market_id=0, event_type="trade", metadata=json.dumps({"ticker": f"T{i % 7}"}), new_value=float(i), timestamp=i) for i in range(300)]
    feed = rows.events(*part).drop("id").repartitionByRange(3, "timestamp").sortWithinPartitions("timestamp")
    mk = rows.markets(*[dict(id=i, external_id=f"T{i}") for i in range(5)])
    numbered = messages.with_arrival(feed).withColumn("place", F.lit(0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.append_events(messages.resolve_tickers(numbered, mk), str(tmp_path), 3)
        got = sorted((r.id, r.timestamp) for r in store.read_events(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [t for _, t in got] == [i for i in range(300) if i % 7 < 5]
    assert [i for i, _ in got] == [(3 << store.BATCH_BITS) + n for n in range(len(got))]
