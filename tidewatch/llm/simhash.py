"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are made per document, then equal ones are merged, so copies cost one row. Two
fingerprints that differ in at most ``max_bits`` of 64 bits agree in at least k of ``max_bits + k`` blocks
of bits; each fingerprint is sent to one cell per choice of k blocks, k growing with the logarithm of
the number of fingerprints. A cell sorts its fingerprints by their rank
in the Gray code and builds an index over the runs of that order: a node keeps the bits that all
its fingerprints share (mask and pattern), and a search gives up a whole node as soon as the
differences to its shared pattern exceed the limit. Large cells are cut into pairs of parts, so a
task holds two bounded parts at most. A cell gives one link per fingerprint (to the smallest it is
connected with there), never all pairs; links are joined to components by star contraction.

Defined results: texts without words have fingerprint zero and are linked as any other; a null
text has no words; null ids are never a component's name unless all its ids are null; repeated rows
give repeated rows; an empty table gives no rows; whole texts are used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settle, slices
from tidewatch.llm.exact_dedup import keep_rows

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PART = 4096  # rows of one part of a cell
_SENT = 100_000  # as many large cells are sent to all tasks; more are joined by a shuffle
_FAN = 16
_QUERIES = 256  # searched at a time, which bounds the open node list
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the hashes of the shingles."""
    words = text.translate(_UPPER).split()  # bytes.split() knows exactly the six characters of white space
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[: len(words) - words_per_shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words_per_shingle - 1:] - 1).tolist())]
    columns = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(columns), 1 << 16):
        set_bits += np.unpackbits(columns[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, body_hash, fp (the 64 bits as a long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 2):
            found = [fingerprint(t or b"", words_per_shingle) for t in batch.column(2).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["doc_id", "body_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(body).alias("body_hash"), body.cast("binary").alias("bytes")).mapInArrow(
        run, f"doc_id {kind}, body_hash long, fp long"
    )


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the order of the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _nodes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits set in all and in any of each run of _FAN."""
    starts = np.arange(0, len(low), _FAN)
    return np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)


def linked_pairs(fp: np.ndarray, group: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (a < b) of one group within ``max_bits``, found block by block.

    Rows must be in order of group and Gray rank. A node's accumulated difference to a query is that
    in the bits which all rows below it share.
    """
    levels = [(fp, fp)]
    while len(levels[-1][0]) > _FAN:
        levels.append(_nodes(*levels[-1]))
    end_of = np.searchsorted(group, group, side="right")
    fan = np.arange(_FAN)
    for at in range(0, len(fp), _QUERIES):
        query = np.arange(at, min(at + _QUERIES, len(fp)))
        top = len(levels) - 1
        first, last = (query + 1) >> (4 * top), (end_of[query] - 1) >> (4 * top)
        n = np.where(end_of[query] > query + 1, last - first + 1, 0)
        who = np.repeat(query, n)
        node = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        for level in range(top, -1, -1):
            all_set, any_set = levels[level]
            pattern, x = all_set[node], fp[who]
            shared = ~(pattern ^ any_set[node])
            near = np.bitwise_count((x ^ pattern) & shared) <= max_bits
            who, node = who[near], node[near]
            if level:
                who = np.repeat(who, _FAN)
                node = (node[:, None] * _FAN + fan).ravel()
                size = 4 * (level - 1)
                inside = (node < len(levels[level - 1][0])) & ((node << size) < end_of[who]) & (((node + 1) << size) > who + 1)
                who, node = who[inside], node[inside]
        yield who, node


def connect(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place of each place's connected component."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def plan(count: int, max_bits: int, fullest: int = 2 * PART) -> tuple[int, int]:
    """Into how many blocks to cut 64 bits, and how many of them make a key.

    Of ``max_bits + k`` blocks at least k agree. More blocks make longer keys, so that a key's share of ``count``
    spread fingerprints stays below ``fullest`` rows, and the copies of a fingerprint do not grow with the rows.
    """
    of = 1
    while of < 4 and count >> (64 * of // (max_bits + of)) > fullest:
        of += 1
    return max_bits + of, of


def keys_of(fp: Column, blocks: int, of: int, first: int = 0) -> list[Column]:
    """The cell keys of a fingerprint: every choice of ``of`` blocks, numbered from ``first`` on, with their bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), of), first):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed number
        out.append(F.struct(F.lit(number).alias("block"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return out


def cells(rows: DataFrame, keys: list[Column], by: str, *more: str) -> DataFrame:
    """The rows once per cell, in order of ``cell``; of large cells every pair of bounded parts is one.

    ``more`` may name "block", the number of the key, as a column behind those of the rows: a row is in one cell
    (all its pairs of parts together) for each.

    What is large is told by a sixteenth of the rows, dealt by a hash: parts are a matter of size only, a cell
    is searched whole with any number of them. A cell's number is a hash of its key; two that share one are
    searched together, which adds no link.
    """
    columns = [*rows.columns, *more]
    routed = rows.select(*rows.columns, F.explode(F.array(*keys)).alias("key")).select(*rows.columns, "key.block", "key.bits")
    sampled = routed.where(F.pmod(F.xxhash64(by, F.lit("size")), F.lit(16)) == 0).groupBy("block", "bits").agg((16 * F.count(F.lit(1))).alias("n"))
    large = settle(sampled.where(F.col("n") > 1.5 * PART).select("block", "bits", F.ceil(F.col("n") / PART).cast("long").alias("parts")))
    key = F.xxhash64("block", "bits")
    found = large.count()
    if not found:
        dealt = routed.select(key.alias("cell"), *columns)
    else:
        marked = routed.join(F.broadcast(large) if found <= _SENT else large, ["block", "bits"], "left")
        part, others = F.pmod(F.xxhash64(by, F.lit("part")), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        cut = marked.withColumn("part", part).withColumn("other", F.explode_outer(F.when(F.col("parts").isNotNull(), others)))
        name = F.xxhash64("block", "bits", F.least("part", "other"), F.greatest("part", "other"))
        dealt = cut.select(F.when(F.col("parts").isNull(), key).otherwise(name).alias("cell"), *columns)
    return dealt.repartition("cell").sortWithinPartitions("cell")


def in_order(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns behind that of the cell, in order of cells and of the Gray rank of the first one, and the number of each row's cell."""
    cell, *rest = columns
    order = np.lexsort((gray_rank(rest[0].view(np.uint64)), cell))
    cell = cell[order]
    return [c[order] for c in rest], np.concatenate([[0], np.cumsum(cell[1:] != cell[:-1])])


def by_cells(search):
    """Runs ``search``, which yields batches, on the columns of whole cells, many at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) < 32 * PART:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            change = np.flatnonzero(columns[0][1:] != columns[0][:-1])
            if len(change):  # the last cell may go on in the next batch
                cut = change[-1] + 1
                yield from search([c[:cut] for c in columns])
                columns = [c[cut:] for c in columns]
            held = [columns]
        if held and len(held[0][0]):
            yield from search([np.concatenate(c) for c in zip(*held)])

    return run


def _links(max_bits: int):
    def search(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (signed,), group = in_order(columns)
        root = connect(len(signed), linked_pairs(signed.view(np.uint64), group, max_bits))
        far = root != np.arange(len(signed))
        yield pa.RecordBatch.from_arrays([pa.array(signed[far]), pa.array(signed[root[far]])], ["a", "b"])

    return by_cells(search)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints within ``max_bits``."""
    keys = keys_of(F.col("fp"), *plan(distinct.count(), max_bits))
    return cells(distinct.select("fp"), keys, "fp").mapInArrow(_links(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of (a, b) but the roots: alternating large and small stars.

    Each round joins edges with per-node minima (partially aggregated; a hot node may be split).
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
        edges = settle(small.distinct())


def assign(docs: DataFrame, max_bits: int = MAX_BITS, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, body_hash, fp, root (the component's fingerprint), component_id of every row."""
    prints = settle(fingerprints(docs, words_per_shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct.select("fp"), max_bits))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = placed.join(named, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "body_hash", "fp", "root", "component_id")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each component with all columns: that with the smallest id (one of repeated rows)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body_hash")).alias("first")
    return keep_rows(docs, assign(docs, **options).groupBy("root").agg(first).select("first.doc_id", "first.body_hash"))


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
