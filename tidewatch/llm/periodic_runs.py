"""Periodic runs of words by a descending-LCP Kruskal over suffixes.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least
``repeats`` periods and ``least`` words long. Suffixes of the documents of a slice are ranked by
prefix doubling (words are numbered per document, so nothing crosses documents); what is unique
leaves. Neighbours in suffix order are edges, weighted by their common words (LCP). Edges are taken
by decreasing LCP: union-find unites suffix classes, each with its ordered set of positions, the
smaller one going into the larger. Two positions i < j that become neighbours in their class at LCP
l agree in exactly l words, and if j - i is small enough against l they seed the run of period j - i
that ends at j + l; it is kept where the word before i does not extend it. No position between them
agrees in l words, so j - i is the smallest period, and every run is seeded once, by its first word
and the word a period later.

Classes in which no two positions are near enough for their largest LCP are left out beforehand.
Memory is proportional to the words of a slice (one long text is a slice of its own) times the
logarithm of the longest repetition.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; words are
what stands between the six characters of white space; ids may be null or of any type; repeated rows
give equal results; an empty table gives no rows; whole texts are used; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WHITE, slices

REPEATS = 4
LEAST = 6
_PIECE = 4 << 20  # bytes of a text that are split into words at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_numbers(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; new ones are added to ``known``."""
    out, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()  # bytes.split() knows exactly the six characters of white space
        for word in set(words).difference(known):
            known[word] = len(known)
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _starts(new: np.ndarray) -> np.ndarray:
    """For every place the last place at or before it where something new begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def doubled_ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ.

    ``ends`` is the end of each place's document. Equal suffixes share the rank of their first place
    in order; only they are sorted again.
    """
    order = np.argsort(words, kind="stable")
    new = np.append(True, words[order][1:] != words[order][:-1])
    rank = np.empty(len(words), np.int32)
    rank[order] = _starts(new)
    levels = [rank]
    left, width = order[~(new & np.append(new[1:], True))], 1
    while len(left):
        then = left + width
        behind = np.where(then < ends[left], rank[np.minimum(then, len(rank) - 1)], -1).astype(np.int64)
        key = (rank[left].astype(np.int64) << 32) | (behind + 1)
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        group = key >> 32
        new = np.append(True, key[1:] != key[:-1])
        moved = _starts(new) - _starts(np.append(True, group[1:] != group[:-1]))
        rank = rank.copy()
        rank[left] = group + moved
        levels.append(rank)
        left, width = left[~(new & np.append(new[1:], True))], 2 * width
    return levels


def common_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` of one document share."""
    length = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[level], -1)
        length += (rank[a + length] == rank[b + length]).astype(np.int64) << level
    return length


def least_common(repeats: int, least: int) -> int:
    """The smallest LCP that can seed a run."""
    return min(max((repeats - 1) * d, least - d) for d in range(1, least + 1))


def _suffix_classes(words: np.ndarray, ends: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order and the LCP of each with the next one, 0 between classes.

    Only classes that share enough words for a run, and in which two places are near enough.
    """
    levels, bound = doubled_ranks(words, ends), least_common(repeats, least)
    level = min(bound.bit_length() - 1, len(levels) - 1)
    order = np.empty(len(words), np.int64)
    order[levels[-1]] = np.arange(len(words))
    joined = np.flatnonzero(levels[level][order[:-1]] == levels[level][order[1:]])
    lcp = np.zeros(len(words), np.int64)
    lcp[joined] = common_words(levels, order[joined], order[joined + 1])
    lcp[lcp < bound] = 0
    inside = (lcp > 0) | np.append(False, lcp[:-1] > 0)
    order, lcp = order[inside], lcp[inside]
    if not len(order):
        return order, lcp
    number = np.append(0, np.cumsum(lcp[:-1] == 0))
    by = np.lexsort((order, number))
    gap = np.append(np.where(number[by][1:] == number[by][:-1], np.diff(order[by]), len(words)), len(words))
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    near = (repeats - 1) * np.minimum.reduceat(gap, first) <= np.maximum.reduceat(lcp, first)
    return order[near[number]], lcp[near[number]]


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def seeds(place: np.ndarray, lcp: np.ndarray, repeats: int) -> list[tuple[int, int, int]]:
    """(i, distance, LCP) of the positions that become neighbours near enough to each other."""
    # In a run the earlier suffix shares more with the next, so places usually come in order and are appended.
    sets, parent, limit, found = [[p] for p in place.tolist()], list(range(len(place))), repeats - 1, []
    edges = np.flatnonzero(lcp)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for edge, common in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = _find(parent, edge), _find(parent, edge + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b], reach = a, [], common // limit
        last = len(small) - 1
        for n, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (not n or large[at - 1] > small[n - 1]) and x - large[at - 1] <= reach:
                found.append((large[at - 1], x - large[at - 1], common))
            if at < len(large) and (n == last or large[at] < small[n + 1]) and large[at] - x <= reach:
                found.append((x, large[at] - x, common))
        if large[-1] < small[0]:
            large += small
        elif 16 * len(small) > len(large):
            large += small
            large.sort()
        else:
            for x in small:
                insort(large, x)
    return found


def runs_of(words: np.ndarray, ends: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """(place, length, period) rows of all runs by place and period; words are numbered per document."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    found = np.array(seeds(*_suffix_classes(words, ends, repeats, least), repeats), np.int64).reshape(-1, 3)
    at, period, common = found.T
    first = (at == 0) | (words[at - 1] != words[at + period - 1])
    runs = np.stack([at, common + period, period], axis=1)[first & (common + period >= least)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(repeats: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 1, 3):
            known: dict[bytes, int] = {}
            texts = [word_numbers(t, known) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            bounds = np.append(0, np.cumsum(sizes))
            doc = np.repeat(np.arange(len(texts)), sizes)
            words = np.concatenate(texts)
            found = runs_of(doc * len(known) + words, bounds[doc + 1], repeats, least)
            depth = np.zeros(len(words) + 1, np.int32)
            np.add.at(depth, found[:, 0] + found[:, 2], 1)
            np.add.at(depth, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(depth)[:-1] == 0
            spelled = list(known)
            collapsed = [b" ".join(map(spelled.__getitem__, words[a:b][kept[a:b]].tolist())) for a, b in zip(bounds, bounds[1:])]
            owner = np.searchsorted(bounds, found[:, 0], side="right") - 1
            starts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            columns = [found[:, 0] - bounds[owner], found[:, 1], found[:, 2]]
            rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(starts), rows), pa.array(collapsed, pa.binary())],
                ["doc_id", "n_words", "runs", "bytes"],
            )

    return run


def collapse(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and collapsed, the text without the repetitions.

    Dropped is every word that a run holds after its first period; kept words are joined by a space.
    """
    if repeats < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes")).mapInArrow(
        _collapse(repeats, least),
        f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, bytes binary",
    )
    return found.select("doc_id", "n_words", "runs", F.col("bytes").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """Of runs in order the first with the greatest exact length / period; null without runs."""
    better = lambda best, x: best["period"].isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, x: F.when(better(best, x), x).otherwise(best))


def repeat_tail(text: Column, key: Column) -> Column:
    """The words of a tenth of the texts with a periodic end, as the hash of the key says; other texts as they are.

    With h the CRC-32 of the key and g = h / 10: if h % 10 = 0, word i from a = g % n on becomes word
    a + (i - a) % p, where p = 1 + (n - a) / (3 + g % 8). Rows without key or words stay.
    """
    words = F.regexp_extract_all(text, F.lit(f"([^{WHITE}]+)"), F.lit(1))
    h = F.crc32(key.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & text.rlike(f"[^{WHITE}]"), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
