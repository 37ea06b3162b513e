"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text gets the mark U+2581 in front and for every space, and is cut before each run of marks (and
around line feeds, which no piece holds): no piece crosses such a cut, so the best segmentation of
the text is that of its marked words. A task sorts the distinct marked words of a run of documents
and walks the trie that they form depth first: the forward scores of a prefix are computed once and
reused by all words below it. The best segmentation has the largest sum of the model's piece scores;
of equal ones, the last piece is the longest. A character that is no piece is encoded as its bytes.

The model file is a parameter, is read by the driver, and is never trained here.

Defined results: null and empty texts have no ids and decode to the empty text; a mark that stands
in the text itself is encoded as bytes, so that decoding gives back every text exactly; repeated
rows get equal results; whole texts of any length are encoded; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import slices, text_arrow

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # of the format: below the least score of a piece
_LITERAL = "\x00"  # begins the stand-in of a mark of the text itself while words are cut
_CACHE = 100_000


@dataclass
class Pieces:
    """What encoding and decoding need of a model file."""

    trie: list  # of the ordinary pieces; a node is [children by character, id or -1, score]
    byte_ids: list[int]  # ids of the 256 bytes
    raw: list[bytes]  # the bytes that an id stands for
    unknown: float
    parts: dict[str, bytes] = field(default_factory=dict)  # packed ids of parts met before, by task


def load(path: str = MODEL_FILE) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, raw = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            if MARK in piece.lstrip(MARK) or "\n" in piece or _LITERAL in piece:
                raise ValueError(f"piece {i} crosses a word boundary")
            ids[piece] = (i, model.get_score(i))
            raw.append(piece.replace(MARK, " ").encode())
    if not all(byte_ids):
        raise ValueError("the model has no byte pieces")
    trie = [{}, -1, 0.0]
    for piece, (i, score) in ids.items():
        node = trie
        for char in piece:
            node = node[0].setdefault(char, [{}, -1, 0.0])
        node[1:] = i, score
    return Pieces(trie, byte_ids, raw, min(s for _, s in ids.values()) - UNKNOWN_PENALTY)


_WORDS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def parts_of(text: str) -> list[str]:
    """The text cut at its spaces; of a run of spaces all but the first lead the part behind it."""
    parts = text.split(" ") if text else []
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return out + [" " * (spaces - 1)] if spaces else out


def marked_words(part: str) -> list[str]:
    """The marked words of a part; a mark and a NUL of the text itself become a NUL with ``m`` or ``0`` behind it."""
    if MARK in part or _LITERAL in part:
        part = part.replace(_LITERAL, _LITERAL + "0").replace(MARK, _LITERAL + "m")
    return _WORDS.findall(MARK + part.replace(" ", MARK))


def _spell(char: str, pieces: Pieces) -> list[int]:
    return [pieces.byte_ids[b] for b in char.encode()]


def encode_sorted(words: list[str], pieces: Pieces) -> Iterator[tuple[str, bytes]]:
    """The packed ids of distinct words in sorted order, keeping the state of the current trie path.

    For every prefix length there is the best score, the start and id of its last piece, and the
    pieces still open there (their starts and places in the trie of pieces).
    """
    score, back, open_at = [0.0], [(0, -1)], [[]]
    path, root, unknown = "", pieces.trie[0], pieces.unknown
    for word in words:
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del score[shared + 1:], back[shared + 1:], open_at[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            char, best, at, still = word[end - 1], None, None, []
            for start, node in open_at[-1]:
                node = node.get(char)
                if node is not None:
                    if node[0]:
                        still.append((start, node[0]))
                    if node[1] >= 0 and (best is None or score[start] + node[2] > best):
                        best, at = score[start] + node[2], (start, node[1])
            node = root.get(char)
            if node is None or node[1] < 0:
                total, piece = score[-1] + unknown, -1
            else:
                total, piece = score[-1] + node[2], node[1]
            if node is not None and node[0]:
                still.append((end - 1, node[0]))
            if best is None or total > best:
                best, at = total, (end - 1, piece)
            score.append(best)
            back.append(at)
            open_at.append(still)
        path = word
        out, end = [], len(word)
        while end:
            start, piece = back[end]
            if piece >= 0:
                out.append(piece)
            else:
                out += reversed(_spell(word[start:end], pieces))
            end = start
        out.reverse()
        yield word, array("i", out).tobytes()


def _encode_words(words: list[str], pieces: Pieces) -> bytes:
    """Marked words of an unusual part, in which a NUL begins a stand-in."""
    names = {_LITERAL + "m": _spell(MARK, pieces), _LITERAL + "0": _spell(_LITERAL, pieces)}
    out = []
    for word in chain.from_iterable(re.split(f"({_LITERAL}[m0])", w) for w in words):
        if word in names:
            out.append(array("i", names[word]).tobytes())
        elif word:
            out += [ids for _, ids in encode_sorted([word], pieces)]
    return b"".join(out)


def packed_ids(texts: list[str], pieces: Pieces) -> list[bytes]:
    """The ids of every text as 32-bit integers."""
    cut = [parts_of(t) for t in texts]
    known, wanted = pieces.parts, set(chain.from_iterable(cut))
    fresh = wanted.difference(known)
    if len(known) + len(fresh) > _CACHE:  # parts that are met again stay
        known = pieces.parts = {w: known[w] for w in wanted if w in known}
    simple = [w for w in fresh if "\n" not in w and MARK not in w and _LITERAL not in w]
    marked = {MARK + w.replace(" ", MARK): w for w in simple}
    known.update((marked[word], ids) for word, ids in encode_sorted(sorted(marked), pieces))
    known.update((w, _encode_words(marked_words(w), pieces)) for w in fresh.difference(simple))
    return [b"".join(map(known.__getitem__, words)) for words in cut]


def encode_texts(texts: list[str], pieces: Pieces) -> list[list[int]]:
    return [np.frombuffer(ids, np.int32).tolist() for ids in packed_ids(texts, pieces)]


def decode_lists(lists: pa.Array, pieces: Pieces) -> pa.Array:
    """The texts of an array of id lists; bytes that form no character are replaced, unknown ids skipped."""
    raw = [*pieces.raw, b""]
    sizes = np.array([len(r) for r in raw])
    table, begin = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    ends_of_lists = lists.offsets.to_numpy()
    ids = lists.values.to_numpy()[ends_of_lists[0]:ends_of_lists[-1]]
    ids = np.where((ids >= 0) & (ids < len(pieces.raw)), ids, len(pieces.raw))
    ends = np.cumsum(sizes[ids])
    data = table[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[ids] - (ends - sizes[ids]), sizes[ids])]
    bounds = np.concatenate([[0], ends])[ends_of_lists - ends_of_lists[0]]
    # The space that encoding put in front goes.
    filled = np.flatnonzero(bounds[:-1] < bounds[1:])
    spaced = filled[data[bounds[filled]] == 32]
    data = np.delete(data, bounds[spaced])
    lengths = np.diff(bounds)
    lengths[spaced] -= 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    whole = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    try:
        whole.validate(full=True)
    except pa.ArrowInvalid:
        held = data.tobytes()
        whole = pa.array([held[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])], pa.large_string())
    return whole.cast(pa.string())


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    return decode_lists(pa.array([ids], pa.list_(pa.int32())), pieces)[0].as_py()


def _encoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 1, 3):
            found = packed_ids(text_arrow(batch.column(1)).to_pylist(), pieces)
            sizes = np.array([len(f) // 4 for f in found], np.int64)
            values = np.frombuffer(b"".join(found), np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(sizes)],
                ["doc_id", "ids", "n_tokens"],
            )

    return run


def _decoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_lists(batch.column(1), pieces)], ["doc_id", "ids", "n_tokens", "text"])

    return run


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, ids, n_tokens of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoded(pieces), f"doc_id {kind}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows of (doc_id, ids, n_tokens) with the decoded text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(_decoded(pieces), f"doc_id {kind}, ids array<int>, n_tokens long, text string")


def round_trip(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Both, one after the other in the same Python worker: doc_id, ids, n_tokens, text."""
    there, back = _encoded(pieces), _decoded(pieces)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: back(there(batches)), f"doc_id {kind}, ids array<int>, n_tokens long, text string")
