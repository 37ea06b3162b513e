"""Removal of near copies: candidates by several SimHash fingerprints, checked by their exact similarity.

Documents are alike if the Jaccard similarity of their sets of shingles (``words`` words, A-Z lower-cased,
fewer words: the whole sequence) is at least ``least``. Near that bound single fingerprints differ in about
nine of 64 bits, too many to be searched exactly. Each document therefore has ``PRINTS`` independent
fingerprints, and each is cut into ``BLOCKS`` blocks; documents meet in a cell for every choice of blocks
of one fingerprint in which they agree. A cell is searched by the hierarchical Gray-order index of
``simhash`` in the first fingerprint; what is near there and in all fingerprints together is a candidate. Cells are
those of two blocks at any number of documents; one of many rows is searched as pairs of bounded parts, so
neither the size of the table nor that of a part has a say in what is found.

All candidates of what stays are compared, but large groups go before that: a document first names its candidate of
the smallest number in each cell. It is compared with the least document of its component, then with its own
candidates among the rest, then in other orders of the numbers as long as that takes groups away. Of the rest all
candidates are paired, each pair in one cell; a pair is left out only if the counts of its shingles by parts of the
hashes show that it cannot be alike. A group of documents near in bits and unlike in fact thus is compared pair by pair.

Those that are alike are settled in rounds: a document with the least draw (a hash of its number) of its open
neighbours stays, and its neighbours go. A chain of documents thus keeps those that are unlike, and rounds grow with
the logarithm of a chain. What went for a document that goes later is compared with all that stay, and settled as
the rest was if it is alike to none. No document goes without an exact check against one that stays, and no two
that meet and are alike stay.

Finding is probabilistic in the bits of the hash (the results are the same in every run): 0.9 and more of
the pairs at similarity 0.8 and above are met (see the tests), more with growing similarity.

Defined results: documents without words (null and empty texts) are alike to each other and to no other;
repeated rows (equal id and text) stay once; null ids are ids; an empty table gives no rows; whole texts are
used; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settle, shared_folder, slices
from tidewatch.llm.exact_dedup import keep_rows, text_hash
from tidewatch.llm.simhash import PART, SEED, by_cells, cells, components, in_order, keys_of, linked_pairs

WORDS = 5
LEAST = 0.8
PRINTS = 2
BLOCKS = 9
KEY_BLOCKS = 2  # blocks in which two fingerprints agree to meet, whatever the number of documents
FIRST_BITS = 16  # differing bits of the first fingerprint, and of all together per fingerprint
ALL_BITS = 14
_KEYS_OF_PRINT = 1000  # the numbers of the second fingerprint's keys begin here
_BINS = 64  # parts of the hashes in which shingles are counted
_FULL = (1 << 16) - 1  # the largest count that is kept; documents of so many shingles are always compared
_AGAIN = 16  # candidates are named again while that takes away more than so many-th of the documents
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECE = 1 << 16  # shingles hashed at a time
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """64-bit hashes of all shingles, repeats included, piece by piece."""
    found = text.translate(_UPPER).split()  # bytes.split() knows exactly the six characters of white space
    if not found:
        return
    digest, last = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    for at in range(0, last, _PIECE):
        piece = found[at:min(at + _PIECE, last) + words - 1]
        joined, ends = b" ".join(piece), np.cumsum([len(w) + 1 for w in piece]) - 1
        n = max(1, len(piece) - words + 1)
        starts = [0, *(ends[:n - 1] + 1).tolist()]
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())], np.uint64)


def fingerprints_of(text: bytes, words: int = WORDS, prints: int = PRINTS) -> list[int]:
    """Independent fingerprints: a bit is set if it is set in more than half of the (remixed) shingle hashes."""
    set_bits, n = np.zeros((prints, 64), np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for i in range(prints):
            if i:
                hashes = hashes + _MIX[0]
                hashes = (hashes ^ (hashes >> np.uint64(30))) * _MIX[1]
                hashes = (hashes ^ (hashes >> np.uint64(27))) * _MIX[2]
                hashes ^= hashes >> np.uint64(31)
            set_bits[i] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(set_bits * 2 > n, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprints(docs: DataFrame, words: int = WORDS, prints: int = PRINTS) -> DataFrame:
    """doc_id, body_hash, fp0, fp1, ... of every row."""
    names = [f"fp{i}" for i in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 2):
            found = np.array([fingerprints_of(t, words, prints) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T)], ["doc_id", "body_hash", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text_hash(F.col("text")).alias("body_hash"), body.cast("binary").alias("bytes")).mapInArrow(
        run, ", ".join([f"doc_id {kind}, body_hash long", *[f"{n} long" for n in names]]))


def blocks_in_key(count: int) -> int:
    """So many blocks would keep a cell's share of ``count`` documents below two parts.

    That tells from which number on cells come in parts. The search does not ask: longer keys find fewer pairs, so it
    takes ``KEY_BLOCKS`` at any size, and larger cells are searched whole, as pairs of parts.
    """
    of = 2
    while of < 4 and count >> (64 * of // BLOCKS) > 2 * PART:
        of += 1
    return of


def _near(prints: list[np.ndarray], group: np.ndarray, first_bits: int, all_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in linked_pairs(prints[0], group, first_bits):
        near = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in prints) <= all_bits * len(prints)
        yield a[near], b[near]


def _nearest(first_bits: int, all_bits: int):
    """(block, a, b): of every row of a cell, or of two parts of one, that has candidates, the least number among them and its own."""
    def search(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (*prints, node, block), group = in_order(columns)
        least, found = node.copy(), np.zeros(len(node), np.bool_)
        for a, b in _near([p.view(np.uint64) for p in prints], group, first_bits, all_bits):
            np.minimum.at(least, a, node[b])
            np.minimum.at(least, b, node[a])
            found[a] = found[b] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (block, node, least)], ["block", "a", "b"])

    return by_cells(search)


def _keys(names: list[str]) -> list[Column]:
    return [k for i, n in enumerate(names) for k in keys_of(F.col(n), BLOCKS, KEY_BLOCKS, _KEYS_OF_PRINT * i)]


def _first_key(apart: list[np.ndarray]) -> np.ndarray:
    """The first key in which two documents agree, from the differing bits of each fingerprint; -1 if there is none."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    first_of = np.full(1 << BLOCKS, -1)
    for number, chosen in reversed([*enumerate(combinations(range(BLOCKS), KEY_BLOCKS))]):
        wanted = sum(1 << i for i in chosen)
        first_of[(np.arange(1 << BLOCKS) & wanted) == wanted] = number
    out = np.full(len(apart[0]), -1)
    for i, bits in reversed([*enumerate(apart)]):
        agree = np.zeros(len(bits), np.int64)
        for j in range(BLOCKS):
            mask = np.uint64(((1 << (edges[j + 1] - edges[j])) - 1) << edges[j])
            agree |= ((bits & mask) == 0).astype(np.int64) << j
        out = np.where(first_of[agree] >= 0, _KEYS_OF_PRINT * i + first_of[agree], out)
    return out


def outlines(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node, n, s0, s1, ... of (node, bytes): the number of distinct shingles and, four in a long, those in each of ``_BINS`` parts of the hashes."""
    names = [f"s{i}" for i in range(_BINS // 4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 1):
            sets = [_shingle_set(t, words) for t in batch.column(1).to_pylist()]
            counts = np.array([np.bincount((s % np.uint64(_BINS)).astype(np.int64), minlength=_BINS) for s in sets]).reshape(-1, _BINS)
            packed = np.minimum(counts, _FULL).astype(np.uint16).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, packed.T)], ["node", "n", *names])

    return texts.select("node", "bytes").mapInArrow(run, ", ".join(["node long, n long", *[f"{n} long" for n in names]]))


def _may_be_alike(n: np.ndarray, bins: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """False only of pairs that cannot be alike: of each bin the two share no more shingles than the smaller count."""
    shared = np.concatenate([np.zeros(0, np.int64), *[
        np.minimum(bins[a[i:i + _PIECE]], bins[b[i:i + _PIECE]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), _PIECE)]])
    both = n[a] + n[b]
    return (shared >= least * (both - shared) - 1e-6) | (np.maximum(n[a], n[b]) >= _FULL)


def _pairs(first_bits: int, all_bits: int, across: bool, least: float):
    """(a, b), b the smaller number: all candidates of every row that may be alike, each in the cell of the first key in which the two agree."""
    def search(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (*prints, node, side, n, block), group = in_order([*columns[:-1 - _BINS // 4], columns[-1]])
        # the same order as above
        (_, *packed), _ = in_order([columns[0], columns[1], *columns[-1 - _BINS // 4:-1]])
        bins = np.ascontiguousarray(np.stack(packed, axis=1)).view(np.uint16)
        prints = [p.view(np.uint64) for p in prints]
        for a, b in _near(prints, group, first_bits, all_bits):
            if across:
                a, b = a[side[a] != side[b]], b[side[a] != side[b]]
            here = (block[a] == block[b]) & (_first_key([p[a] ^ p[b] for p in prints]) == block[a])
            a, b = a[here], b[here]
            here = _may_be_alike(n, bins, a, b, least)
            a, b = node[a[here]], node[b[here]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return by_cells(search)


def met(prints: DataFrame, first_bits: int = FIRST_BITS, all_bits: int = ALL_BITS) -> DataFrame:
    """(a, b) of (node, fp0, fp1, ...): every document that has candidates with the least one of each cell, or itself if that is less."""
    names = [c for c in prints.columns if c.startswith("fp")]
    same = settle(prints.groupBy(*names).agg(F.min("node").alias("node")))  # equal fingerprints meet in their least document
    equal = prints.join(same.withColumnRenamed("node", "least"), names).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = cells(same.select(*names, "node"), _keys(names), "node", "block").mapInArrow(_nearest(first_bits, all_bits), "block int, a long, b long")
    # the parts of a cell each name a least one; that of the whole cell counts, so candidates do not grow with the parts
    whole = found.groupBy("block", "a").agg(F.min("b").alias("b")).select("a", "b")
    return whole.unionByName(equal).distinct()


def candidates(prints: DataFrame, first_bits: int = FIRST_BITS, all_bits: int = ALL_BITS) -> DataFrame:
    """(a, b) of (node, fp0, fp1, ...): of each document the least candidate of each cell, b the smaller number.

    Enough to take large groups away; ``all_candidates`` has the others.
    """
    return met(prints, first_bits, all_bits).where("a <> b")


def all_candidates(prints: DataFrame, others: DataFrame | None = None, first_bits: int = FIRST_BITS, all_bits: int = ALL_BITS, least: float = LEAST) -> DataFrame:
    """(a, b) of (node, fp0, fp1, ..., n, s0, s1, ...): all pairs of documents that meet and may be alike by their ``outlines``.

    b is the smaller number; with ``others`` the pairs are those of the two tables.
    """
    names = [c for c in prints.columns if c.startswith("fp")]
    bins = [f"s{i}" for i in range(_BINS // 4)]
    rows = prints.select(*names, "node", F.lit(0).cast("long").alias("side"), "n", *bins)
    if others is not None:
        rows = rows.unionByName(others.select(*names, "node", F.lit(1).cast("long").alias("side"), "n", *bins))
    # two parts of a cell also hold the pairs within each
    return cells(rows, _keys(names), "node", "block").mapInArrow(_pairs(first_bits, all_bits, others is not None, least), "a long, b long").distinct()


def of_each(pairs: DataFrame) -> DataFrame:
    """(a, others) of (a, b): one row a document, so that what is joined by ``a`` does not grow with its candidates.

    Of those a document has at most one for each key, and one of equal fingerprints, however large its group is.
    """
    return pairs.groupBy("a").agg(F.collect_list("b").alias("others"))


def groups(edges: DataFrame) -> DataFrame:
    """``components`` of candidates, of which a document has many: first by the least one of each, which makes trees.

    Only what connects two trees is left for the second time.
    """
    trees = settle(components(edges.groupBy("a").agg(F.min("b").alias("b"))))
    one, other = (trees.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    # every a is in a tree below its least candidate, a b may be the root of one
    below = of_each(edges).join(one, "a").select("root_a", F.explode("others").alias("b")).distinct()
    between = below.join(other, "b", "left").select(F.col("root_a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = settle(components(between))
    found = trees.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return found.select("node", F.coalesce("top", "root").alias("root")).unionByName(above)


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes; 1 of two empty ones."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both) if len(one) or len(other) else 1.0


def _shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def alike(pairs: DataFrame, texts: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts, (node, bytes), are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shingles = None, None
        for batch in slices(batches, 500, 3):
            a, b, one, other = (c.to_pylist() for c in batch.columns)
            kept = []
            for x, y, s, t in zip(a, b, one, other):
                if y != name:  # the rows of a partition are in order of b
                    name, shingles = y, _shingle_set(t, words)
                kept.append(similarity(_shingle_set(s, words), shingles) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    with_one = of_each(pairs).join(texts.select(F.col("node").alias("a"), F.col("bytes").alias("one")), "a")
    both = with_one.select("a", F.explode("others").alias("b"), "one").join(
        texts.select(F.col("node").alias("b"), F.col("bytes").alias("other")), "b")
    return both.select("a", "b", "one", "other").sortWithinPartitions("b").mapInArrow(run, "a long, b long")


def _settled_links(links: DataFrame) -> DataFrame:
    """(node) of (a, b), alike: documents that go, each alike to one that does not, so that no two of the rest are linked."""
    gone = []
    while not (links := settle(links)).isEmpty():
        draw = lambda c: F.struct(F.xxhash64(c, F.lit("draw")), F.col(c))
        both = _both_ways(links)
        stays = both.groupBy("a").agg(F.min(draw("b")).alias("next")).where(draw("a") < F.col("next")).select(F.col("a").alias("b"))
        out = settle(both.join(stays, "b", "left_semi").select(F.col("a").alias("node")).distinct())
        gone.append(out)
        # those that stay have no neighbour left
        links = links.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    return reduce(DataFrame.unionByName, gone) if gone else links.select(F.col("a").alias("node"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _thinned(prints: DataFrame, edges: DataFrame, texts: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The documents (node) that stay, no two of them alike as far as they meet, and those that are now alike to none of them.

    ``edges`` are ``candidates``. What they leave names candidates again, in other orders, as long as that takes
    groups away; then all candidates of the rest are compared.
    """
    roots = settle(groups(edges).select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = [settle(alike(roots, texts, words, least))]
    gone = found[0].select(F.col("a").alias("node"))
    still = roots.select(F.col("a").alias("node")).join(gone, "node", "left_anti")
    found.append(settle(alike(settle(_among(edges, still)), texts, words, least)))
    gone = gone.unionByName(_settled_links(found[1]))
    compared, before = edges, prints.count()
    left = settle(prints.join(gone, "node", "left_anti"))
    while _AGAIN * (before - (now := left.count())) > before:
        order = F.lit(xxhash.xxh64_intdigest(b"order %d" % len(found), SEED) >> 2)
        named = candidates(left.drop("n", *[c for c in left.columns if c.startswith("s")]).withColumn("node", F.col("node").bitwiseXOR(order)))
        again = named.select(*[F.col(c).bitwiseXOR(order).alias(c) for c in "ab"])
        again = settle(again.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).join(compared, ["a", "b"], "left_anti"))
        found.append(settle(alike(again, texts, words, least)))
        compared, before = settle(compared.unionByName(again)), now
        left = settle(left.join(_settled_links(found[-1]), "node", "left_anti"))
    rest = settle(all_candidates(left, least=least).join(compared, ["a", "b"], "left_anti"))
    stay = settle(left.join(_settled_links(settle(alike(rest, texts, words, least))), "node", "left_anti").select("node"))
    # what went for one that goes itself is not done
    links = _both_ways(reduce(DataFrame.unionByName, found))
    near = links.join(stay.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node"))
    return stay, settle(prints.select("node").join(left.select("node"), "node", "left_anti").join(near, "node", "left_anti"))


def copies(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, body_hash) of the documents that go: each is alike to one that stays."""
    spark = docs.sparkSession
    prints = settle(fingerprints(docs, words).distinct().withColumn("node", F.monotonically_increasing_id()))
    every = prints.drop("doc_id", "body_hash")
    pairs = settle(met(every))
    nodes = settle(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    named = prints.join(nodes, "node").select("node", "doc_id", "body_hash")
    folder = shared_folder(spark, "near-copies")
    body = docs.select("doc_id", text_hash(F.col("text")).alias("body_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    same = body["doc_id"].eqNullSafe(named["doc_id"]) & (body["body_hash"] == named["body_hash"])
    # equal rows give a text twice; one is enough
    body.join(named, same).select("node", "bytes").dropDuplicates(["node"]).write.parquet(folder)
    texts = spark.read.schema("node long, bytes binary").parquet(folder)

    every = settle(every.join(outlines(texts, words), "node"))
    open_, stays = every, nodes.limit(0)
    while True:
        stay, lost = _thinned(open_, pairs.where("a <> b"), texts, words, least)
        stays = settle(stays.unionByName(stay))
        if lost.isEmpty():
            break
        # each is compared with all that stay; what is alike to none of them is settled as the rest was
        one, other = (every.join(x, "node", "left_semi") for x in (lost, stay))
        known = _both_ways(settle(alike(settle(all_candidates(one, other, least=least)), texts, words, least))).select(F.col("a").alias("node"))
        open_ = settle(one.join(known, "node", "left_anti"))
        pairs = settle(met(open_.select(prints.drop("doc_id", "body_hash").columns)))
    return named.join(stays, "node", "left_anti").select("doc_id", "body_hash")


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    of_these = of_each(edges).join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").select("a", F.explode("others").alias("b"))
    return of_these.join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def dedup(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents without near copies, with all their columns."""
    return keep_rows(docs, copies(docs, words, least), "left_anti")
