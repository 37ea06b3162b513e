"""Removal of repeated byte strings, by ranks of growing prefixes at sampled positions.

Prefix doubling over every byte position would shuffle some 16 bytes a position and round, many times
the text. So ranks are kept at anchors: of every window of ``window`` bytes the ``GRAM`` bytes with
the smallest hash (the leftmost of equal ones). Equal windows have the same anchor, so nothing is
missed, and about one position in sixteen is one. In rounds of growing length

1. Spark sorts anchors by the rank of their ``GRAM`` bytes; those unique to a document are dropped,
   and with them every window that has one as its anchor.
2. What is left is ranked by all bytes of the windows around the anchor. In all documents but
   the first of such a class the whole stretch is repeated: past the threshold, done.
3. Only first documents of classes whose gram has other classes too (the ends of repeated passages)
   go on. The windows around an anchor are taken in four quarters; Spark sorts the quarters by the
   rank of the 43 or so bytes that all windows of one share, and drops those in one row only.
4. The windows left are ranked by their full length and sorted by (rank, document).

Ranks are hashes: 64 bits in rounds 1 and 3, where a clash only keeps an anchor too many, 128 bits in
rounds 2 and 4. Before each sort, tasks settle what their own rows decide, so a hot string adds a row per
task to its key and not a row per document. Each round is parked as Parquet in the shared folder.

Defined results: a null or empty text has nothing to remove; texts shorter than the window neither;
equal ids are never smaller than one another, so repeated rows get equal results; null ids come
after all others: nothing is removed from them and nothing on their account; matches end with the
document; texts of any length are cut into bounded pieces; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import shared_folder, slices

WINDOW = 50
GRAM = 20
_PIECE = 1 << 20  # bytes hashed at a time
_FLUSH = 1 << 20  # anchors gathered by a task before it sends them on
_FRONT, _BACK = 64, 160  # zeros around a buffer, so that reads past a text's ends are harmless
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def park(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; the shuffle files of the write are dropped with it."""
    spark = df.sparkSession
    folder, before = shared_folder(spark, "repeats"), spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[0]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


class Buffer:
    """Bytes of several texts, readable as 8-byte words at any place."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.n, self.starts, self.ends = len(data), starts, ends
        padded = np.concatenate([np.zeros(_FRONT, np.uint8), data, np.zeros(_BACK, np.uint8)])
        self.words = np.ndarray((len(padded) - 7,), np.uint64, padded.data, 0, (1,))

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at + _FRONT]

    def hash(self, at: np.ndarray, length: int, seed: int) -> np.ndarray:
        """Hash of ``length`` bytes from each place on, all inside their texts."""
        out = np.full(len(at), seed, np.uint64)
        for off in [*range(0, length - 8, 8), length - 8]:
            out = _mix(out ^ self.word(at + off) * _K[2])
        return out

    def hash_clipped(self, at: np.ndarray, before: int, after: int, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
        """Hash of the bytes from ``before`` ahead of each place to ``after`` behind it, cut to low..high."""
        start = at - before
        left, right = np.maximum(low - start, 0), np.maximum(at + after - high, 0)
        out = _mix(np.uint64(seed) ^ (left.astype(np.uint64) << np.uint64(32)) ^ right.astype(np.uint64))
        total, full = before + after, np.uint64(0xFFFFFFFFFFFFFFFF)
        for off in range(0, total, 8):
            word = self.word(start + off)
            skip = np.clip(left - off, 0, 8)
            drop = np.clip(off + 8 - (total - right), 0, 8)
            keep = np.where(skip < 8, full << (8 * np.minimum(skip, 7)).astype(np.uint64), np.uint64(0))
            keep &= np.where(drop < 8, full >> (8 * np.minimum(drop, 7)).astype(np.uint64), np.uint64(0))
            out = _mix(out ^ (word & keep) * _K[3])
        return out

    def window_anchors(self, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, window starts, their anchors), piece by piece, in order."""
        span, low_bits = window - gram + 1, np.uint64((1 << 31) - 1)
        for base in range(0, self.n, _PIECE):
            size = min(_PIECE, self.n - base) + span - 1
            at = slice(base + _FRONT, base + _FRONT + size)
            far = lambda off: self.words[at.start + off: at.stop + off] if at.stop + off <= len(self.words) else np.pad(
                self.words[at.start + off:], (0, at.stop + off - len(self.words)))
            key = np.zeros(size, np.uint64)
            for off in [*range(0, gram - 8, 8), gram - 8]:
                key = _mix(key ^ far(off) * _K[2])
            key = (key & ~low_bits) | np.arange(size, dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if width < span:
                key = np.minimum(key[: len(key) - (span - width)], key[span - width:])
            first = np.searchsorted(self.ends, base, "right")
            last = np.searchsorted(self.starts, base + len(key), "left")
            texts = np.arange(first, last)
            begin = np.maximum(self.starts[texts], base)
            count = np.maximum(np.minimum(self.ends[texts] - window + 1, base + len(key)) - begin, 0)
            place = _ranges(begin, count)
            yield np.repeat(texts, count), place, (key[place - base] & low_bits).astype(np.int64) + base


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def anchors(buffer: Buffer, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in the buffer) of all distinct anchors, in order."""
    owners, places, last = [], [], -1
    for owner, _, at in buffer.window_anchors(window, gram):
        if len(at):
            new = np.concatenate([[at[0] != last], at[1:] != at[:-1]])
            owners.append(owner[new])
            places.append(at[new])
            last = at[-1]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(owners), np.concatenate(places)) if owners else (empty, empty)


def buffer_of(column: pa.Array) -> Buffer:
    """Of a binary column without nulls; the bytes are those of Arrow's own buffer."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    return Buffer(data, offsets[:-1], offsets[1:])


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, starts of groups in that order, and the group number of each place in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


# --- keys found in several rows: rounds 1 and 3 ------------------------------------------------

_ENTRY = "key long, row_key long, pos long"  # pos < 0: -1 the key is shared, else surely kept at -2 - pos


def _entries(keys_of):
    """Entries (key, row, position) of texts; what a task knows to be shared is said with the entry."""
    def flush(held: list) -> pa.RecordBatch:
        key, row, pos = (np.concatenate(c) for c in zip(*held))
        order, starts, group = _groups(key)
        sorted_row = row[order]
        shared = (np.minimum.reduceat(sorted_row, starts) != np.maximum.reduceat(sorted_row, starts))
        sure = np.zeros(len(key), bool)
        sure[order] = shared[group]
        tokens = key[order][starts[shared]]
        # Kept rows need no key any more: one drawn from their place spreads them over the tasks.
        key = np.where(sure, _signed(_mix(row.view(np.uint64) + pos.astype(np.uint64))), key)
        pos = np.where(sure, -2 - pos, pos)
        none = np.zeros(len(tokens), np.int64)
        return _batch([np.concatenate([key, tokens]), np.concatenate([row, none]), np.concatenate([pos, none - 1])],
                      ["key", "row_key", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 2000, 1, 2):
            found = keys_of(batch)
            if len(found[0]):
                held.append(found)
                size += len(found[0])
            if size >= _FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _gram_keys(window: int, gram: int):
    """Of (row_key, bytes): the bytes at every anchor."""
    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, buffer = batch.column(0).to_numpy(), buffer_of(batch.column(1))
        owner, place = anchors(buffer, window, gram)
        return _signed(buffer.hash(place, gram, 1)), rows[owner], place - buffer.starts[owner]

    return keys


def quarters(window: int, gram: int) -> list[tuple[int, int]]:
    """(bytes before, bytes from the anchor on) that all windows of a quarter hold, by how far before it they begin."""
    step = -(-(window - gram + 1) // 4)
    return [(first, window - min(first + step - 1, window - gram)) for first in range(0, window - gram + 1, step)]


def _quarter_keys(window: int, gram: int):
    """Of (row_key, bytes, wanted): what the windows of each quarter of a wanted anchor share; pos is 4 x place + quarter."""
    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, buffer = batch.column(0).to_numpy(), buffer_of(batch.column(1))
        owner, pos = _positions(batch.column(2))
        at = pos + buffer.starts[owner]
        out = []
        for j, (before, after) in enumerate(quarters(window, gram)):
            fits = (pos >= before) & (at + after <= buffer.ends[owner])
            out.append((_signed(buffer.hash(at[fits] - before, before + after, 5 + j)), rows[owner[fits]], 4 * pos[fits] + j))
        return tuple(map(np.concatenate, zip(*out)))

    return keys


def _in_several_rows(texts: DataFrame, keys_of) -> DataFrame:
    """(row_key, pos) of the entries whose key is in several rows: Spark sorts by key, tokens first."""
    entries = texts.mapInArrow(_entries(keys_of), _ENTRY)
    return entries.repartition("key").sortWithinPartitions("key", "pos", "row_key").mapInArrow(_keep_shared, "row_key long, pos long")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Columns of sorted batches cut at changes of the first ``n_keys`` columns, but a long group comes in parts.

    With each piece: whether its first group goes on from the piece before, and its last into the next.
    """
    held, going = None, False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        held = columns if held is None else [np.concatenate(c) for c in zip(held, columns)]
        if len(held[0]) < 20_000:
            continue
        change = np.zeros(len(held[0]) - 1, bool)
        for key in held[:n_keys]:
            change |= key[1:] != key[:-1]
        at = np.flatnonzero(change)
        if len(at):
            cut = at[-1] + 1
            yield [c[:cut] for c in held], going, False
            held, going = [c[cut:] for c in held], False
        elif len(held[0]) > 500_000:
            yield [c[:-1] for c in held], going, True
            held, going = [c[-1:] for c in held], True
    if held is not None and len(held[0]):
        yield held, going, False


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, pos, row_key), so tokens come first -> (row_key, pos) of keys in several rows.

    A long group comes in parts. While all of it is of one row, its positions are held, since another row may
    follow; they are one text's anchors, which were in memory at once when that text was read.
    """
    known, lone, held = False, None, []  # of the group in progress: whether it is shared, else its one row and positions
    for (key, row, pos), going, goes_on in _runs(batches, 1):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        low = np.minimum.reduceat(row, starts)
        shared = (np.minimum.reduceat(pos, starts) == -1) | (low != np.maximum.reduceat(row, starts))
        if going:
            shared[0] |= known or low[0] != lone
            if shared[0] and held:
                before = np.concatenate(held)
                yield _batch([np.full(len(before), lone, np.int64), before], ["row_key", "pos"])
        if not going or len(starts) > 1 or shared[0]:
            held = []
        known, lone = bool(shared[-1]), low[-1]
        if goes_on and not known:
            last = pos[starts[-1]:]
            held.append(last[last >= 0])
        keep = (pos <= -2) | ((pos >= 0) & shared[group])
        yield _batch([row[keep], np.where(pos < 0, -2 - pos, pos)[keep]], ["row_key", "pos"])


# --- round 2 ---------------------------------------------------------------------------------

_CLASS = "gram_key long, class_key long, doc_id long, row_key long, pos int"


def _classes(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, 2, 2):
            doc, row, buffer = batch.column(0).to_numpy(), batch.column(1).to_numpy(), buffer_of(batch.column(2))
            owner, pos = _positions(batch.column(3))
            at = pos + buffer.starts[owner]
            context = buffer.hash_clipped(at, window - gram, window, buffer.starts[owner], buffer.ends[owner], 2)
            yield _batch([_signed(buffer.hash(at, gram, 1)), _signed(context), doc[owner], row[owner], pos.astype(np.int32)],
                         ["gram_key", "class_key", "doc_id", "row_key", "pos"])

    return run


def _positions(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of all items of a list column."""
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy().astype(np.int64)


# --- round 4 ---------------------------------------------------------------------------------

_WINDOW_ROW = "key long, check long, doc_id long, row_key long, pos int"  # pos < 0: surely repeated, at -1 - pos


def _windows(window: int, gram: int):
    def flush(held: list) -> pa.RecordBatch:
        key, check, doc, row, pos = (np.concatenate(c) for c in zip(*held))
        order, starts, group = _groups(key, check)
        later = np.zeros(len(key), bool)
        later[order] = doc[order] > np.minimum.reduceat(doc[order], starts)[group]
        key = np.where(later, _signed(_mix(row.view(np.uint64) + pos.astype(np.uint64))), key)
        return _batch([key, check, doc, row, np.where(later, -1 - pos, pos).astype(np.int32)],
                      ["key", "check", "doc_id", "row_key", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 2000, 2, 2):
            doc, row, buffer = batch.column(0).to_numpy(), batch.column(1).to_numpy(), buffer_of(batch.column(2))
            owner, code = _positions(batch.column(3))
            open_quarters, step = np.zeros(buffer.n, np.uint8), quarters(window, gram)[1:2]
            np.bitwise_or.at(open_quarters, code // 4 + buffer.starts[owner], (1 << (code % 4)).astype(np.uint8))
            width = step[0][0] if step else window
            for owner, start, at in buffer.window_anchors(window, gram):
                good = (open_quarters[at] >> ((at - start) // width).astype(np.uint8)) & 1 > 0
                owner, start = owner[good], start[good]
                if len(start):
                    held.append((_signed(buffer.hash(start, window, 3)), _signed(buffer.hash(start, window, 4)),
                                 doc[owner], row[owner], start - buffer.starts[owner]))
                    size += len(start)
            if size >= _FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _keep_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, check, doc_id) -> (row_key, pos) of windows that a smaller document has."""
    least = None  # the smallest document of the group in progress
    for (key, check, doc, row, pos), going, _ in _runs(batches, 2):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        first = doc[starts].copy()
        if going:
            first[0] = least
        least = first[-1]
        keep = (pos < 0) | (doc > first[group])
        yield _batch([row[keep], np.where(pos < 0, -1 - pos, pos)[keep].astype(np.int32)], ["row_key", "pos"])


# --- removal ---------------------------------------------------------------------------------

def cut(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and runs removed, for the union of the given stretches."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _removal(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, 1, 2):
            out = []
            spans = [c.to_pylist() for c in (batch.column(2), batch.column(3))]
            for text, whole, single in zip(batch.column(1).to_pylist(), *spans):
                text = text or b""
                if not whole and not single:
                    out.append((len(text), 0, 0, text))
                    continue
                a, p = np.array(whole or [], np.int64), np.array(single or [], np.int64)
                begin = np.concatenate([np.maximum(a - (window - gram), 0), p])
                end = np.concatenate([np.minimum(a + window, len(text)), p + window])
                left, removed, runs = cut(text, begin, end)
                out.append((len(text), removed, runs, left))
            n, removed, runs, left = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The texts with their row_key, and per row_key anchors of repeated stretches and repeated single windows."""
    if not 8 <= gram < window:
        raise ValueError("the gram must have at least 8 bytes and be shorter than the window")
    body = F.coalesce("text", F.lit(""))
    # Equal rows have equal keys. A key is only a way to find texts again: positions are looked up in the text.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", body).alias("row_key"),
                        body.cast("binary").alias("bytes"))
    known = texts.where("doc_id is not null").where(F.length("bytes") >= window)

    shared = _in_several_rows(known.select("row_key", "bytes"), _gram_keys(window, gram))
    alive = park(shared.groupBy("row_key").agg(F.collect_set("pos").alias("alive")))

    classes = park(known.join(alive, "row_key").select("doc_id", "row_key", "bytes", "alive").mapInArrow(_classes(window, gram), _CLASS))
    first = park(classes.groupBy("gram_key", "class_key").agg(F.min("doc_id").alias("first_id")))
    several = first.groupBy("gram_key").agg((F.min("class_key") != F.max("class_key")).alias("several")).where("several")
    first = first.join(several, "gram_key", "left")
    placed = park(classes.join(first, ["gram_key", "class_key"]).where("doc_id > first_id or several").select(
        "row_key", "pos", (F.col("doc_id") > F.col("first_id")).alias("later"))
        .groupBy("row_key").agg(
            F.collect_set(F.when(F.col("later"), F.col("pos"))).alias("whole"),
            F.collect_set(F.when(~F.col("later"), F.col("pos"))).alias("wanted")))

    wanted = placed.where(F.size("wanted") > 0).select("row_key", "wanted")
    open_parts = _in_several_rows(known.join(wanted, "row_key").select("row_key", "bytes", "wanted"), _quarter_keys(window, gram))
    open_parts = park(open_parts.groupBy("row_key").agg(F.collect_set("pos").alias("open")))
    rows = known.join(open_parts, "row_key").select("doc_id", "row_key", "bytes", "open").mapInArrow(_windows(window, gram), _WINDOW_ROW)
    later = rows.repartition("key").sortWithinPartitions("key", "check", "doc_id").mapInArrow(_keep_later, "row_key long, pos int")
    single = park(later.groupBy("row_key").agg(F.collect_set("pos").alias("single")))
    spans = placed.where(F.size("whole") > 0).select("row_key", "whole").join(single, "row_key", "full")
    return texts, park(spans)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every row."""
    texts, spans = repeated(docs, window, gram)
    joined = texts.join(spans, "row_key", "left").select("doc_id", "bytes", "whole", "single")
    return joined.mapInArrow(_removal(window, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(rows: list[tuple[int, bytes]], window: int = WINDOW) -> list[tuple[int, int, int, int, str]]:
    """The same result from the definition, for tests."""
    least: dict[bytes, int] = {}
    for doc, text in rows:
        for p in range(len(text) - window + 1):
            s = text[p:p + window]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, text in rows:
        at = np.array([p for p in range(len(text) - window + 1) if least[text[p:p + window]] < doc], np.int64)
        left, removed, runs = cut(text, at, at + window)
        out.append((doc, len(text), removed, runs, hashlib.sha256(left).hexdigest()))
    return out
