"""The streaming buffer against the batch operator, with late and repeated rows, and its state."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.operators import quality as q
from tidewatch.streaming import buffer, sources

MIN, DAY = 60_000, 86_400_000
ONCE = {"availableNow": True}


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None
    progress = query.recentProgress
    query.stop()
    return progress


def start(spark, tmp_path, per_market=5, age=DAY):
    src = sources.table_files(spark, str(tmp_path / "in"), schemas.EVENTS, 1)
    return buffer.start_buffers(src, str(tmp_path / "out"), str(tmp_path / "cp"), per_market, age, ONCE)


def shown(df):
    return sorted(map(tuple, df.select([f.name for f in schemas.EVENTS]).collect()), key=repr)


def test_stream_equals_batch(rows, spark, tmp_path):
    chance = random.Random(4)
    made = [dict(id=i, market_id=i % 3, event_type=("trade", "price_change")[i % 2], old_value=None if i % 4 else 0.5, new_value=i / 100,
                 metadata=None if i % 5 else "{}", timestamp=10 * DAY + i * 60 * MIN) for i in range(60)]
    # a late row, repeated rows, and rows of one time
    parts = [made[:25], [made[3], made[30], *made[25:40], made[30]], [*made[40:53], *made[54:], dict(made[50], id=500), made[12]], [made[53], made[52]]]
    for name, part in zip("abcd", parts):
        chance.shuffle(part)
        rows.events(*part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    finish(start(spark, tmp_path))
    now = 10 * DAY + 59 * 60 * MIN
    everything = rows.events(*[r for part in parts for r in part])
    want = q.recent_buffer(everything, now, per_market=5)
    got = buffer.read_buffers(spark, str(tmp_path / "out"), now)
    assert shown(got) == shown(want) and want.count() == 15
    assert [tuple(r) for r in q.buffer_stats(got, now).collect()] == [tuple(r) for r in q.buffer_stats(want, now).collect()]
    buffer.fold_buffers(spark, str(tmp_path / "out"), now)
    assert shown(buffer.read_buffers(spark, str(tmp_path / "out"), now)) == shown(want)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 1


def test_state_shrinks_after_a_day_of_silence(rows, spark, tmp_path):
    def feed(name, *parts):
        rows.events(*[dict(id=i, market_id=m, timestamp=t) for i, (m, t) in enumerate(parts)]).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    feed("a", *[(m, DAY + m) for m in range(20)])
    feed("b", (100, DAY + 1000))
    assert finish(start(spark, tmp_path))[-1].stateOperators[0].numRowsTotal > 20
    # one market goes on; the others have been silent for a day when the watermark passes
    feed("c", (100, 3 * DAY))
    feed("d", (100, 3 * DAY + MIN))
    feed("e", (100, 3 * DAY + 2 * MIN))
    finish(start(spark, tmp_path))
    feed("f", (100, 3 * DAY + 3 * MIN))
    state = finish(start(spark, tmp_path))[-1].stateOperators[0].numRowsTotal
    assert state < 20
    assert {r.market_id for r in buffer.read_buffers(spark, str(tmp_path / "out"), 3 * DAY + 3 * MIN).collect()} == {100}


@pytest.fixture(scope="module", autouse=True)
def _one_partition(spark):
    """State stores are per partition; few are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
