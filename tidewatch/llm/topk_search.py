"""Exact top-k search by inner product with an impact-ordered index, score at a time.

Components become integers (floor of ``scale`` times the value). Vectors are dealt to shards of bounded
size; a task builds the index of its shard once and sends all queries through it as they come. A shard
keeps, for every dimension and either sign, posting segments: the vectors of one quantised impact
(how far the component lies above the shard's least). A query adds segments to all scores in
descending impact. After every few segments the k-th best lower bound is compared with the upper
bounds (what a segment still to come may add, and what quantising has cut off); it stops only when
the possible members are proven to be few, or at the end, and scores all of them exactly.

Sums are bounded beforehand by a shard's largest components and the query's: where 63 bits might not do,
that search runs on whole numbers of any size instead of 64-bit ones. Ranks are always those of the exact
scores; a score outside 64 bits is reported as the nearest 64-bit number.

Defined results: a null vector, and one with a null or non-finite component, takes no part; missing
components of shorter vectors are 0; of rows with a query's id the smallest vector is the query, and
none of them is a candidate for it; repeated candidates count each; ties go to the smaller id (null
ids are neither queries nor candidates; ids must be whole numbers); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import slices

K = 10
SCALE = 1024
LEVELS = 32  # quantised impacts per dimension
SHARD_ROWS = 4_096
_CHECKS = 16  # the bounds are compared after every such part of the segments
_ENOUGH = 4  # stop early when so many times k members are possible
_SAFE = 1 << 62
_WIDTH = 272  # bytes that hold every sum of products of finite doubles as whole numbers


def integers(vector: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers, still doubles: those beyond 64 bits keep their value."""
    # floor() gives 64-bit numbers; from 2^53 on a double is whole already
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


class ImpactIndex:
    """Posting segments of a shard for both signs of a query's component.

    Numbers are 64-bit or, for sums that might not fit, Python's (an array of objects).
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.kind = rows.dtype
        self.low, self.high = self.rows.min(axis=0), self.rows.max(axis=0)
        self.width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS)).astype(self.kind)
        # of every sign (0: positive) and dimension, one behind the other: the places in order of levels, and where each level begins
        size, n = self.rows.shape[1], len(self.ids)
        self.posted = np.empty((2, size, n), np.int32)
        self.starts = np.empty((2, size, LEVELS + 2), np.int64)
        for sign in (0, 1):
            above = (self.high - self.rows) if sign else (self.rows - self.low)
            level = (above // self.width).astype(np.int64)
            for d in range(size):
                by = np.argsort(level[:, d], kind="stable")
                self.posted[sign, d] = by
                self.starts[sign, d] = (sign * size + d) * n + np.searchsorted(level[by, d], np.arange(LEVELS + 2))
        self.posted = self.posted.ravel()

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates of the shard, in order."""
        size = abs(query)
        step = size * self.width
        # What the levels cut off: at most a level's width less one in every dimension.
        slack = int((size * np.minimum(self.width - 1, self.high - self.low)).sum())
        score = np.zeros(len(self.ids), self.kind)
        candidate = self.ids != own
        if not candidate.any():
            return self.ids[:0], score[:0]
        first, impact, count, still = self._in_order(step, self.starts[(query < 0).astype(np.int64), np.arange(len(query))])
        take, k = max(1, -(-len(first) // _CHECKS)), min(k, int(candidate.sum()))
        possible = candidate
        for at in range(0, len(first), take):
            until = min(at + take, len(first))
            many = count[at:until]
            place = np.arange(int(many.sum())) + np.repeat(first[at:until] - (np.cumsum(many) - many), many)
            np.add.at(score, self.posted[place], np.repeat(impact[at:until], many))
            lower = score[possible]
            bar = np.sort(lower)[len(lower) - k] if self.kind == object else np.partition(lower, len(lower) - k)[len(lower) - k]
            # A vector scored in a dimension gets no more there, but which ones is not kept: the bound is loose.
            possible = candidate & (score + int(still[until - 1]) + slack >= bar).astype(bool)
            if possible.sum() <= _ENOUGH * k:
                break
        else:
            lower = score[possible]
            bar = np.sort(lower)[len(lower) - k]
            possible = candidate & (score + slack >= bar).astype(bool)
        members = np.flatnonzero(possible)
        exact = self.rows[members] @ query
        best = np.lexsort((self.ids[members], -exact))[:k] if self.kind != object else np.array(
            sorted(range(len(members)), key=lambda i: (-exact[i], self.ids[members[i]]))[:k], np.int64)
        return self.ids[members][best], exact[best]

    def _in_order(self, step: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Begin, impact and length of the segments in descending impact, and what all dimensions may add behind each."""
        count = starts[:, 2:] - starts[:, 1:-1]
        d, l = np.nonzero((count > 0) & (step != 0)[:, None])
        impact = step[d] * (l + 1).astype(self.kind)
        # by dimensions and ascending impact here: a segment is followed by the one before it
        next_one = np.append(np.zeros(1, self.kind), impact[:-1])[:len(impact)]
        next_one[np.append(True, d[1:] != d[:-1])[:len(d)]] = 0
        last = np.append(d[1:] != d[:-1], True)[:len(d)]
        order = np.array(sorted(range(len(d)), key=lambda i: -impact[i]), np.int64) if self.kind == object else np.argsort(-impact, kind="stable")
        # equal impacts are of different dimensions: each dimension's come in descending order
        still = impact[last].sum() - np.cumsum((impact - next_one)[order])
        return starts[d, l + 1][order], impact[order], count[d, l][order], still


class Shard:
    """The vectors of a shard; an index in the numbers that a query needs is built when it is first asked for."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.size = max(map(len, vectors))
        self.ids = ids
        self.rows = np.stack([np.pad(v, (0, self.size - len(v))) for v in vectors])
        self.largest = abs(self.rows).max(axis=0)
        self.built: dict[bool, ImpactIndex] = {}

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, exact score) of the k best candidates."""
        # components beyond the shard's vectors meet zeros only
        query = np.pad(query, (0, max(0, self.size - len(query))))[:self.size]
        # a bound of all sums on the way: products, spans of impacts and what quantising cuts off
        safe = bool((abs(query) * (4.0 * self.largest + 4 * LEVELS)).sum() < _SAFE) and abs(query).max(initial=0) < _SAFE and self.largest.max(initial=0) < _SAFE / 4
        if safe not in self.built:
            rows = self.rows.astype(np.int64) if safe else _whole(self.rows)
            self.built[safe] = ImpactIndex(self.ids, rows)
        ids, scores = self.built[safe].search(query.astype(np.int64) if safe else _whole(query), own, k)
        return list(zip(ids.tolist(), scores.tolist()))


def _whole(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(v) for v in values.ravel()]
    return out


def order_key(score: int) -> bytes:
    """Bytes in the order of whole numbers."""
    return (score + (1 << (8 * _WIDTH - 1))).to_bytes(_WIDTH, "big")


def _searched(k: int):
    """(shard, asks, vec_id, ints) in order of shard and asks -> the best of every query in the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, vectors, shard = None, [], [], None
        for batch in slices(batches, 256):
            out = []
            for at, asks, vec_id, ints in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                values = ints.values.to_numpy()
                if at != number:
                    number, ids, vectors, shard = at, [], [], None
                if not asks:
                    ids.append(vec_id)
                    vectors.append(values.copy())
                    continue
                if ids and shard is None:
                    shard = Shard(np.array(ids, np.int64), vectors)
                if shard is not None:
                    out += [(vec_id, found, score) for found, score in shard.search(values, vec_id, k)]
            top = (1 << 63) - 1
            fits = [-top - 1 <= score <= top for *_, score in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, *_ in out], pa.int64()), pa.array([v for _, v, _ in out], pa.int64()),
                 pa.array([max(-top - 1, min(top, s)) for *_, s in out], pa.int64()),
                 # only scores that 64 bits do not hold need more to be ranked by
                 pa.array([None if ok else order_key(s) for ok, (*_, s) in zip(fits, out)], pa.binary())],
                ["query_id", "vec_id", "score", "wide"],
            )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) that ``is_query`` marks."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("ints"), is_query.alias("asks"))
    queries = rows.where("asks").groupBy("vec_id").agg(F.min("ints").alias("ints"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "ints")
    held = rows.select(F.pmod(F.xxhash64("vec_id", "ints"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "ints")
    dealt = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long, wide binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("wide", F.lit(b""))), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
