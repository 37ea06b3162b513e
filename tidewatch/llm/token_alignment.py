"""Cross-tokenizer alignment by an associative monoid of fragments.

A text behind a space is cut by two tokenizers, A (byte-level BPE) and B (SentencePiece with byte
fallback). Byte offsets where a token of either ends cut the tokens into groups; all pairs of an A
and a B token of one group are links. A *fragment* is what a byte range of a text knows of this:
the open prefix (tokens up to its first common end; more may come in front), the closed groups, and
the open suffix (tokens behind its last common end). Two neighbouring fragments compose: the open
suffix and the open prefix between them are cut at the common ends of both. Composition is
associative, so fragments of a text can be reduced in any tree.

Texts of more than ``chunk`` bytes are cut into byte ranges (each tokenizer's range ends at its own
next safe place, where no token crosses, so the two ranges may differ), dealt over tasks and composed
by a tree of ``FAN`` fragments a node. Shorter texts are a range of their own. In both, what lies
between spaces at which both tokenizers cut is a fragment with closed ends only, computed once a task
for equal words.

The count of an id pair is the number of documents that hold it linked. Pairs are counted per block
(the documents of a slice), then over all blocks; each block gets the counts of the pairs that it
holds, so nothing that grows with the corpus is sent to all tasks.

Vocabulary files are parameters, are read by the driver and never trained. Special tokens' strings in
a text are plain text.

Defined results: texts that are null, empty or do not come back from the tokens' bytes (a U+2581 in
the text) have no tokens, no groups and no links; ids may be null or of any type; repeated rows are
documents of their own, and each counts; an empty table gives no rows; whole texts are used; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settle, shared_folder, slices, text_arrow

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 8
BLOCK_ROWS = 4000
MARK = "▁"
# Fixed value: the words of byte-level BPE, which no token crosses.
A_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLICE = 250  # rows, and MB of text, that a task works on at a time
_SLICE_MB = 1
_FRESH = 8_000  # new words aligned at a time
_CACHE = 60_000
_REMEMBER = 64  # longer words hardly come again
_CUT = re.compile(r" (?<!  )(?=\S)")  # a single space with something behind it: no token of either crosses its front


@dataclass
class Fragment:
    """Tokens as (id, byte offset of the end); closed groups as text, links and numbers."""

    head: tuple[list, list] = field(default_factory=lambda: ([], []))
    tail: tuple[list, list] = field(default_factory=lambda: ([], []))
    cut: bool = False  # whether there is a common end; without one all tokens are in the head
    groups: list[str] = field(default_factory=list)
    links: Counter = field(default_factory=Counter)
    n_groups: int = 0
    n_links: int = 0

    def close(self, a: list, b: list) -> None:
        a, b = [i for i, _ in a], [i for i, _ in b]
        self.groups.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        self.n_groups += 1
        self.n_links += len(a) * len(b)
        for x in a:
            for y in b:
                self.links[x << 32 | y] += 1


def _groups(a: list, b: list) -> tuple[list[tuple[list, list]], tuple[list, list]]:
    """The groups that common ends close, and the tokens behind the last one."""
    out, i, j, n, m = [], 0, 0, 0, 0
    while n < len(a) and m < len(b):
        if a[n][1] < b[m][1]:
            n += 1
        elif a[n][1] > b[m][1]:
            m += 1
        else:
            n, m = n + 1, m + 1
            out.append((a[i:n], b[j:m]))
            i, j = n, m
    return out, (a[i:], b[j:])


def fragment(a: list, b: list) -> Fragment:
    """Of the tokens of a range: what lies between its first and its last common end is closed."""
    closed, rest = _groups(a, b)
    if not closed:
        return Fragment(head=rest)
    out = Fragment(head=closed[0], tail=rest, cut=True)
    for group in closed[1:]:
        out.close(*group)
    return out


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    open_left = left.tail if left.cut else left.head
    middle = fragment(open_left[0] + right.head[0], open_left[1] + right.head[1])
    if left.cut and middle.cut:  # the group that the middle thought open begins at the left one's last common end
        first = Fragment()
        first.close(*middle.head)
        parts = [left, first, middle]
        head = left.head
    else:
        parts, head = [left, middle], left.head if left.cut else middle.head
    parts.append(right)
    tail = right.tail if right.cut else middle.tail if middle.cut else middle.head if left.cut else ([], [])
    out = Fragment(head, tail, left.cut or middle.cut)
    for part in parts:
        out.groups += part.groups
        out.links.update(part.links)
        out.n_groups += part.n_groups
        out.n_links += part.n_links
    return out


def finish(root: Fragment) -> Fragment:
    """Of a whole text: its start and end are common ends."""
    start = Fragment(cut=True)
    return compose(start, root) if root.cut else start


class Word(NamedTuple):
    """What stands behind a space up to the next cut: all its groups are closed. Without tokens it does not come back from their bytes."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes  # a 64-bit number for each link: A's id times the size of B's vocabulary, and B's id


def byte_level() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones are themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, their ids' bytes, and the words met before."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        of_char, model = byte_level(), json.loads(a_json)["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.a_raw = [bytes(map(of_char.__getitem__, t)) for t in [*sorted(of_char, key=model["vocab"].__getitem__), *merged]]
        if any(model["vocab"][t] != i for i, t in enumerate(merged, len(of_char))):
            raise ValueError("the ids of A's vocabulary are not in the order of its merges")
        # tiktoken merges by rank, which is the id here; it is several times as fast as the file's own library
        self.a = tiktoken.Encoding("A", pat_str=A_WORDS, mergeable_ranks={t: i for i, t in enumerate(self.a_raw)}, special_tokens={})
        self.b_raw = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.sizes = [np.array([len(x) for x in raw]) for raw in (self.a_raw, self.b_raw)]
        self.spelled = [[np.array([f"{i}{end}" for i in range(len(raw))], object) for end in ends]
                        for raw, ends in ((self.a_raw, ",|"), (self.b_raw, ",;"))]
        self.young: dict[str, Word] = {}
        self.old: dict[str, Word] = {}

    def tokens(self, text: str, start: int = 0) -> tuple[list[tuple[int, int]], bool]:
        """A's (id, end) of a text, and whether their bytes are the text."""
        return self._ends(self.a.encode_ordinary(text), self.a_raw, text, start)

    def pieces(self, text: str, start: int = 0) -> tuple[list[tuple[int, int]], bool]:
        """B's (id, end) of a space and the text, and whether their bytes are just that."""
        return self._ends(self.b.encode(text, num_threads=1) if text else [], self.b_raw, " " + text if text else "", start)

    @staticmethod
    def _ends(ids: list[int], raw, text: str, start: int) -> tuple[list[tuple[int, int]], bool]:
        parts = [raw[i] for i in ids]
        ends = (start + np.cumsum([len(p) for p in parts], dtype=np.int64)).tolist()
        return list(zip(ids, ends)), b"".join(parts) == text.encode()

    def _aligned(self, words: list[str]) -> list[Word]:
        """The words, all at once: behind each other they are one text, in which every word's end is a common end."""
        if not words:
            return []
        whole = "".join([" " + w for w in words])
        a, pieces = self.a.encode_ordinary(whole), self.b.encode(words, num_threads=1)
        b = list(chain.from_iterable(pieces))
        if any(b"".join([raw[i] for i in ids]) != whole.encode() for raw, ids in ((self.a_raw, a), (self.b_raw, b))):
            if len(words) == 1:
                return [Word(0, 0, 0, "", b"")]
            half = len(words) // 2
            return self._aligned(words[:half]) + self._aligned(words[half:])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b)))
        common = ends_b[ends_a[np.minimum(np.searchsorted(ends_a, ends_b), len(a) - 1)] == ends_b]
        until_a, until_b = (np.searchsorted(ends, common, side="right") for ends in (ends_a, ends_b))  # tokens up to each group's end
        group_a, group_b = (np.searchsorted(common, ends) for ends in (ends_a, ends_b))
        in_b = np.diff(until_b, prepend=0)
        # every A token with all B tokens of its group
        each = in_b[group_a]
        first = np.cumsum(each) - each
        other = np.arange(int(each.sum())) + np.repeat((until_b - in_b)[group_a] - first, each)
        links = (np.repeat(a, each) * len(self.b_raw) + b[other]).tobytes()
        # a group's A tokens, then its B tokens
        spelled = np.empty(len(a) + len(b), object)
        for ids, until, place, (more, end) in ((a, until_a, np.arange(len(a)) + (until_b - in_b)[group_a], self.spelled[0]),
                                               (b, until_b, np.arange(len(b)) + until_a[group_b], self.spelled[1])):
            spelled[place] = more[ids]
            spelled[place[until - 1]] = end[ids[until - 1]]
        spelled = spelled.tolist()
        to_b = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(words)))
        to_a = np.searchsorted(ends_a, ends_b[to_b - 1]) + 1
        to_link = 8 * np.append(0, np.cumsum(each))[to_a]
        n_groups = np.diff(np.searchsorted(common, ends_a[to_a - 1], side="right"), prepend=0)
        out, text_at, link_at = [], 0, 0
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        for row in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), (to_a + to_b).tolist(), to_link.tolist()):
            out.append(Word(*row[:3], "".join(spelled[text_at:row[3]])[:-1], links[link_at:row[4]]))
            text_at, link_at = row[3:]
        return out

    def words(self, wanted: set[str]) -> dict[str, Word]:
        """The words; those met of late are kept."""
        found = {w: self.young[w] for w in wanted.intersection(self.young)}
        for w in wanted.intersection(self.old).difference(found):
            found[w] = self.young[w] = self.old[w]
        fresh = sorted(wanted.difference(found))
        for at in range(0, len(fresh), _FRESH):
            some = fresh[at:at + _FRESH]
            for w, x in zip(some, self._aligned(some)):
                found[w] = x
                if len(w) <= _REMEMBER:
                    self.young[w] = x
        if len(self.young) > _CACHE:
            self.young, self.old = {}, self.young
        return found


def words_of(text: str) -> list[str]:
    """What stands behind each cut of a space and the text."""
    first, *words = _CUT.split(" " + text)
    return [first[1:], *words] if first else words


class Sums(NamedTuple):
    """Of every text: whether all its words have tokens, numbers, groups, links and how often each stands in it."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    ends: np.ndarray  # of each text's distinct links
    pairs: np.ndarray
    times: np.ndarray


def add_words(texts: list[list[str]], known: dict[str, Word], size_b: int) -> Sums:
    """The words of every text put together; texts with a word that has no tokens have none."""
    names = list(known)
    place = {w: i for i, w in enumerate(names)}
    held = [known[w] for w in names]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    word = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    n_a, n_b, n_groups = (np.array([w[i] for w in held], np.int64) for i in range(3))
    n_links = np.array([len(w.links) // 8 for w in held], np.int64)
    valid = np.ones(len(texts), bool)
    valid[doc[n_a[word] == 0]] = False
    doc, word = doc[valid[doc]], word[valid[doc]]
    whole = [np.bincount(doc, n[word], len(texts)).astype(np.int64) for n in (n_a, n_b, n_groups, n_links)]
    groups = [";".join([known[w].groups for w in t]) if ok else "" for t, ok in zip(texts, valid)]
    # the links of each distinct word of a text, then those of equal pairs put together
    key, times = np.unique(doc * len(names) + word, return_counts=True)
    doc, word = np.divmod(key, max(1, len(names)))
    pairs = np.frombuffer(b"".join([w.links for w in held]), np.int64)
    all_pairs = int(pairs.max(initial=0)) + 1
    each = n_links[word]
    at = np.arange(int(each.sum())) + np.repeat((np.cumsum(n_links) - n_links)[word] - (np.cumsum(each) - each), each)
    key = np.repeat(doc, each) * all_pairs + pairs[at]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    times = np.add.reduceat(np.repeat(times, each)[order], first) if len(first) else np.zeros(0, np.int64)
    doc, pair = np.divmod(key[first], all_pairs)
    pairs = (pair // size_b) << 32 | pair % size_b
    return Sums(valid, *whole, groups, np.searchsorted(doc, np.arange(len(texts)), side="right"), pairs, times)


_LOADED: dict[str, Aligner] = {}


@dataclass
class Vocabularies:
    """The contents of the two files, as the driver read them."""

    a_json: str
    b_model: bytes

    def aligner(self) -> Aligner:
        """That of this Python process."""
        name = hashlib.sha256(self.a_json.encode() + self.b_model).hexdigest()
        if name not in _LOADED:
            _LOADED[name] = Aligner(self.a_json, self.b_model)
        return _LOADED[name]


def load(a_file: str = A_FILE, b_file: str = B_FILE) -> Vocabularies:
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        return Vocabularies(a.read(), b.read())


_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


def _whole_texts(vocabularies: Vocabularies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, number = vocabularies.aligner(), TaskContext.get().partitionId(), 0
        for block in slices(batches, BLOCK_ROWS, 1):
            for batch in slices([block], _SLICE, 1, _SLICE_MB):
                cut = [words_of(t) if t else [] for t in text_arrow(batch.column(1)).to_pylist()]
                found = add_words(cut, aligner.words(set().union(*cut)), len(aligner.b_raw))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *map(pa.array, found[1:5]), pa.array(found.groups, pa.string()),
                     _lists(found.ends, found.pairs, pa.int64()), _lists(found.ends, found.times, pa.int32()),
                     pa.array(np.full(len(cut), part << 32 | number))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "block"],
                )
            number += 1

    return run


def _next_cut(data: bytes, at: int, for_pieces: bool) -> int:
    """The first place from ``at`` on that no token of A, or of B, crosses."""
    while 0 <= (at := data.find(b" ", at)) < len(data) - 1:
        behind = data[at + 1:at + 5].decode("utf-8", "ignore")[:1]
        if (at == 0 or data[at - 1] != 0x20) if for_pieces else behind and not behind.isspace():
            return at
        at += 1
    return len(data)


def ranges_of(text: str, chunk: int) -> Iterator[tuple[int, int, str, int, str]]:
    """(number, start for A, text for A, start for B, text for B behind its space) of the byte ranges of a space and the text."""
    data, a, b = (" " + text).encode(), 0, 0
    for number, at in enumerate(range(0, len(data), chunk)):
        a_end, b_end = (_next_cut(data, at + chunk, x) if at + chunk < len(data) else len(data) for x in (False, True))
        a_end, b_end = max(a, a_end), max(b, b_end)
        yield number, a, data[a:a_end].decode(), b, data[b + 1:b_end].decode()
        a, b = a_end, b_end


def _ranges(chunk: int):
    names = ["key", "doc_id", "number", "a_start", "a_text", "b_start", "b_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2):
            rows = list(zip(*ranges_of(batch.column(2)[0].as_py(), chunk)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            keys = [pa.array([batch.column(i)[0].as_py()] * len(rows[0]), batch.column(i).type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, k) for c, k in zip(rows, kinds)]], names)

    return run


def range_fragment(aligner: Aligner, a_start: int, a_text: str, b_start: int, b_text: str) -> tuple[Fragment, int, int, bool]:
    """Fragment, number of tokens of A and B, and whether their bytes are the text, of a byte range."""
    if a_start != b_start or a_text != " " + b_text:
        (a, valid_a), (b, valid_b) = aligner.tokens(a_text, a_start), aligner.pieces(b_text, b_start)
        return fragment(a, b), len(a), len(b), valid_a and valid_b
    first, *rest = words_of(b_text)
    (a, valid_a), (b, valid_b) = aligner.tokens(" " + first, a_start), aligner.pieces(first, b_start)
    out = fragment(a, b)
    if not (valid_a and valid_b and out.cut):
        return out, 0, 0, False
    more = add_words([rest], aligner.words(set(rest)), len(aligner.b_raw))
    out.groups += [g for g in more.groups if g]
    out.links.update(dict(zip(more.pairs.tolist(), more.times.tolist())))
    out.n_groups, out.n_links = out.n_groups + int(more.n_groups[0]), out.n_links + int(more.n_links[0])
    return out, len(a) + int(more.n_a[0]), len(b) + int(more.n_b[0]), bool(more.valid[0])


_TOKENS = "array<struct<id:long,at:long>>"
_FRAGMENT = ("number long, valid boolean, n_a long, n_b long, cut boolean, n_groups long, n_links long, groups string, pairs array<long>, "
             f"times array<int>, a_head {_TOKENS}, b_head {_TOKENS}, a_tail {_TOKENS}, b_tail {_TOKENS}")


def _arrow(schema_of: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema_of)


def _row(number: int, found: Fragment, n_a: int, n_b: int, valid: bool) -> dict:
    sides = {f"{x}_{y}": [{"id": i, "at": e} for i, e in getattr(found, y)[x == "b"]] for x in "ab" for y in ("head", "tail")}
    return dict(number=number, valid=valid, n_a=n_a, n_b=n_b, cut=found.cut, n_groups=found.n_groups, n_links=found.n_links,
                groups=";".join(found.groups), pairs=list(found.links), times=list(found.links.values()), **sides)


def _of_row(row: dict) -> Fragment:
    side = lambda name: [(t["id"], t["at"]) for t in row[name]]
    return Fragment((side("a_head"), side("b_head")), (side("a_tail"), side("b_tail")), row["cut"], [row["groups"]] * bool(row["groups"]),
                    Counter(dict(zip(row["pairs"], row["times"]))), row["n_groups"], row["n_links"])


def _fragment_schema(doc_id: pa.DataType) -> pa.Schema:
    tokens = pa.list_(pa.struct([("id", pa.int64()), ("at", pa.int64())]))
    whole = ["number", "n_a", "n_b", "n_groups", "n_links"]
    names = [c.split()[0] for c in _FRAGMENT.split(", ")]
    kinds = {c: pa.int64() for c in whole} | {c: pa.bool_() for c in ("valid", "cut")} | {
        "groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
    return pa.schema([("key", pa.int64()), ("doc_id", doc_id), *[(n, kinds.get(n, tokens)) for n in names]])


def _leaves(vocabularies: Vocabularies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = vocabularies.aligner()
        for batch in slices(batches, 16):
            rows = [{"key": r["key"], "doc_id": r["doc_id"]} | _row(
                r["number"], *range_fragment(aligner, r["a_start"], r["a_text"], r["b_start"], r["b_text"])) for r in batch.to_pylist()]
            yield from _arrow(_fragment_schema(batch.schema.field("doc_id").type), rows).combine_chunks().to_batches()

    return run


def _composed(table: pa.Table) -> tuple[dict, Fragment, int, int, bool]:
    """The first row of a node, and what its fragments are together."""
    rows = sorted(table.to_pylist(), key=lambda r: r["number"])
    whole = _of_row(rows[0])
    for row in rows[1:]:
        whole = compose(whole, _of_row(row))
    return rows[0], whole, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), all(r["valid"] for r in rows)


def _node(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Composes the neighbouring fragments of one node of a text's tree."""
    first, *whole = _composed(table)
    row = {"key": first["key"], "doc_id": first["doc_id"]} | _row(key[1].as_py(), *whole)
    return _arrow(_fragment_schema(table.schema.field("doc_id").type), [row])


def _root(table: pa.Table) -> pa.Table:
    """Composes the last fragments of a text and finishes it."""
    first, whole, n_a, n_b, valid = _composed(table)
    whole = finish(whole) if valid else Fragment()
    row = dict(doc_id=first["doc_id"], n_a=n_a * valid, n_b=n_b * valid, n_groups=whole.n_groups, n_links=whole.n_links,
               groups=";".join(whole.groups), pairs=list(whole.links), times=list(whole.links.values()), block=-1 - first["key"])
    return _arrow(pa.schema([("doc_id", table.schema.field("doc_id").type), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                             ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("block", pa.int64())]), [row])


def _long_texts(docs: DataFrame, vocabularies: Vocabularies, chunk: int, kind: str) -> DataFrame:
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    ranges = settle(keyed.mapInArrow(
        _ranges(chunk), f"key long, doc_id {kind}, number long, a_start long, a_text string, b_start long, b_text string"))
    most = ranges.agg(F.max("number").alias("n")).first().n or 0
    schema = f"key long, doc_id {kind}, {_FRAGMENT}"
    found = ranges.repartition("key", "number").mapInArrow(_leaves(vocabularies), schema)
    while most >= FAN:
        found = found.groupBy("key", F.floor(F.col("number") / FAN)).applyInArrow(_node, schema)
        most //= FAN
    return found.groupBy("key").applyInArrow(_root, f"doc_id {kind}, {_RESULT}, block long")


def align(docs: DataFrame, vocabularies: Vocabularies, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs (A's id << 32 | B's id), times and block of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > chunk
    short = rows.where(~long).mapInArrow(_whole_texts(vocabularies), f"doc_id {kind}, {_RESULT}, block long")
    return short.unionByName(_long_texts(rows.where(long), vocabularies, chunk, kind))


def stored(aligned: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, so that tokenizing is done once."""
    folder = shared_folder(aligned.sparkSession, "alignment")
    aligned.write.option("compression", "zstd").parquet(folder)
    return aligned.sparkSession.read.parquet(folder)


def pairs_of_blocks(aligned: DataFrame) -> DataFrame:
    """(block, pair, n): how many documents of a block hold the pair."""
    return aligned.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count(F.lit(1)).alias("n"))


def link_counts(blocks: DataFrame) -> DataFrame:
    """pair, n_docs, and whether that is the highest of its A id."""
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _judge(docs: pa.Table, counts: pa.Table) -> pa.Table:
    docs = docs.combine_chunks()
    pairs = docs.column("pairs").combine_chunks()
    sizes = np.diff(pairs.offsets.to_numpy())
    flat, times = pairs.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    known = counts.column("pair").to_numpy()
    order = np.argsort(known)
    at = order[np.searchsorted(known, flat, sorter=order)] if len(known) else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(sizes))

    def sums(values: np.ndarray) -> pa.Array:
        whole = np.append(0, np.cumsum(values))
        return pa.array(whole[ends[1:]] - whole[ends[:-1]], pa.int64())

    n_best = sums(times * counts.column("best").to_numpy(zero_copy_only=False)[at].astype(np.int64))
    count_sum = sums(times * counts.column("n_docs").to_numpy()[at])
    return docs.drop_columns(["pairs", "times", "block"]).append_column("n_best", n_best).append_column("count_sum", count_sum)


def with_counts(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but the links, and n_best and count_sum of every row; ``aligned`` must not change (``stored``)."""
    blocks = settle(pairs_of_blocks(aligned))
    answers = blocks.join(link_counts(blocks), "pair").select("block", "pair", "n_docs", "best")
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times", "block")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_best long", "count_sum long"])
    rows = aligned.select(*[f"`{f.name}`" for f in kept], "pairs", "times", "block")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_judge, schema)
