"""Exact top-k against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import topk_search


def by_hand(rows, k=10):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(1024 * x)) for x in v]))
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit("x"))


@pytest.mark.parametrize("shard", [8192, 100])
def test_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    random = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in random.normal(size=16)]) for i in range(700)]
    common = rows[5][1]
    rows += [(1000 + i, common) for i in range(300)]  # one very common vector, so ties
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2100, [float("inf")] * 16), (None, common),
             (2003, []), (2004, [1.0]), (2200, [0.0] * 16), (200, rows[7][1]), (3, rows[3][1]), (2300, [3.0] * 20)]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == by_hand(rows)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, -2.0]), (1, [0.5, 0.5]), (2, [-1.0, 3.0])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == by_hand(rows)
    assert topk_search.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert topk_search.top_k(vectors(spark, rows[:1]), F.col("vec_id") % 100 == 0).count() == 0
    assert topk_search.top_k(vectors(spark, rows[1:]), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("spread", [1, 50, 10**6])
def test_search_of_one_shard(spread):
    random = np.random.default_rng(spread)
    rows = random.integers(-spread, spread + 1, (500, 8))
    index = topk_search.ImpactIndex(np.arange(500), rows)
    for query in random.integers(-spread, spread + 1, (40, 8)):
        ids, scores = index.search(query, 17, 10)
        want = sorted((-int(rows[i] @ query), i) for i in range(500) if i != 17)[:10]
        assert [(-s, i) for i, s in zip(ids, scores)] == want


@pytest.mark.parametrize("kind", [np.int64, object])
def test_segments_come_whole_and_in_descending_impact(kind):
    """All postings of a query are laid out at once, not one by one, with what every dimension may still add behind each."""
    random = np.random.default_rng(3)
    rows = random.integers(-40, 41, (90, 6)).astype(kind)
    index = topk_search.ImpactIndex(np.arange(90), rows)
    for query in [*random.integers(-9, 10, (10, 6)), np.array([0, 3, 0, -2, 0, 0]), np.zeros(6, np.int64)]:
        query = query.astype(kind)
        step = abs(query) * index.width
        first, impact, count, still = index._in_order(step, index.starts[(query < 0).astype(np.int64), np.arange(6)])
        assert [int(x) for x in impact] == sorted(map(int, impact), reverse=True)
        above = np.where(query < 0, index.high - index.rows, index.rows - index.low)
        want = (step * (above // index.width)).sum(axis=1)
        got = [0] * 90
        for n, (at, x, many) in enumerate(zip(first, impact, count)):
            for place in index.posted[at:at + many]:
                got[place] += int(x)
            rest = [max(map(int, impact[n + 1:][(first[n + 1:] // 90 % 6) == d]), default=0) for d in range(6)]
            assert sum(rest) == int(still[n])
        assert got == [int(x) for x in want]


@pytest.mark.parametrize("largest", [1e7, 1e10, 1e17, 1e300])
def test_large_components_are_exact(spark, largest):
    """Sums that 64 bits do not hold are ranked by Python's whole numbers; scores beyond them are the nearest ones."""
    random = np.random.default_rng(int(np.log10(largest)))
    rows = [(0, [largest, 1.0]), (1, [2 * largest, 2.0]), (2, [1.0, 1.0]), (3, [-largest, 0.0]), (4, [0.0, 5.0]), (100, [-largest, largest]), (5, [largest, 0.9])]
    rows += [(10 + i, [float(x) for x in random.normal(size=2) * largest * 10.0 ** -random.integers(0, 12)]) for i in range(60)]
    got = sorted(map(tuple, topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    top = 2**63 - 1
    assert got == [(q, n, i, max(-top - 1, min(top, s))) for q, n, i, s in by_hand(rows)]


def test_rows_of_one_large_pair(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [1.0, 1.0]), (3, [-1e7, 0.0]), (4, [0.0, 5.0])]
    got = sorted(map(tuple, topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    assert [r[2] for r in got] == [1, 2, 4, 3]


def test_whole_numbers_keep_their_order_as_bytes():
    numbers = [-(2**2100), -(2**64), -(2**63) - 1, -1, 0, 1, 2**63, 2**64 + 1, 2**2100]
    keys = [topk_search.order_key(n) for n in numbers]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
