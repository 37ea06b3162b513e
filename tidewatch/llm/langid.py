"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point alone. The three letters of
an n-gram are permuted by their place (rotated) and bound (multiplied); a document is the bundle
(sum, repeats included) of all its n-grams' vectors, and so is a language, over learning documents
of equal weight. A document gets the language whose prototype has the largest cosine with it.
Words are lower-cased and padded with a boundary symbol; n-grams never span two words.

Learning takes at most about ``sample_per_lang`` documents of each language, chosen by a hash of the
id; a prototype is a sum of whole numbers, so order does not matter and reruns agree.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing was learned; ties go to the smaller language name; a null id is never held out; whole
texts of any length are used; repeated rows get equal results; other columns are carried or ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settle, slices, text_arrow

DIMENSIONS = 1024
SAMPLE_PER_LANG = 2000
MAX_SENT_LABELS = 10_000
UNKNOWN = "und"
_UNIT = 1 << 16
_WORD = (1 << 64) - 1


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1 (int8), a function of the code point only (bits of a mixed counter)."""
    words = np.arange((dimensions + 63) // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (words + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def bind(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of n-grams given as three code points in 21 bits each."""
    parts = [(codes >> np.int64(s)) & np.int64(0x1FFFFF) for s in (42, 21, 0)]
    points, at = np.unique(np.concatenate(parts), return_inverse=True)
    base = letter_vectors(points, dimensions)
    first, second, third = np.split(at, 3)
    return np.roll(base, 2, axis=1)[first] * np.roll(base, 1, axis=1)[second] * base[third]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the texts, and the number of the text of each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in lowered]]) - 1
    known = letters()[points]
    symbols = np.where(known, points, 0).astype(np.int64)
    stay = known | np.concatenate([[True], known[:-1]])  # one boundary between words
    symbols, owner = symbols[stay], owner[stay]
    codes = symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:]
    inside = symbols[1:-1] > 0
    return codes[inside], owner[1:-1][inside]


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row per text: the sum of the vectors of its n-grams (zero if it has none)."""
    out = np.zeros((len(texts), dimensions), np.float32)
    codes, owner = ngrams(texts)
    if not len(codes):
        return out
    at, distinct = pd.factorize(codes)
    vectors = bind(np.asarray(distinct), dimensions)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if ends[i] < ends[i + 1]:
            counts = np.bincount(at[ends[i]:ends[i + 1]])
            used = np.flatnonzero(counts)
            out[i] = counts[used].astype(np.float32) @ vectors[used].astype(np.float32)
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, sample_per_lang: int = SAMPLE_PER_LANG) -> dict[str, np.ndarray]:
    """(doc_id, text, lang) -> prototype vectors. Languages are a bounded set of labels."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = settle(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    few = counts.count() <= MAX_SENT_LABELS  # then their counts go to all tasks, and no text is shuffled
    chosen = labelled.join(F.broadcast(counts) if few else counts, "lang").where(
        F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < F.lit(float(sample_per_lang << 20)) / F.col("n")
    ).select("text", "lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1000, 0):
            unit = np.rint(_units(bundles(text_arrow(batch.column(0)).to_pylist(), dimensions)) * _UNIT).astype(np.int64)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + unit[langs == lang].sum(axis=0)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)],
                ["lang", "dim", "value"],
            )

    found = chosen.mapInArrow(sums, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in found.collect():
        out.setdefault(row.lang, np.zeros(dimensions))[row.dim] = row.value
    return {lang: out[lang] for lang in sorted(out)}


def predict(texts: list[str], prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and cosines (negative ones as 0)."""
    rows = bundles(texts, dimensions)
    empty = ~rows.any(axis=1)
    if not prototypes:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    names = list(prototypes)
    cosines = _units(rows) @ _units(np.stack([prototypes[n] for n in names])).T
    best = cosines.argmax(axis=1)
    score = np.where(empty, 0.0, np.clip(cosines[np.arange(len(texts)), best], 0, 1))
    has = [bool(letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) if e else True
           for t, e in zip(texts, empty)]
    return [names[b] if h else UNKNOWN for b, h in zip(best, has)], score


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 1):
            names, score = predict(text_arrow(batch.column(1)).to_pylist(), prototypes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = 0.0) -> DataFrame:
    """The rows, with all columns, whose language is known with at least ``min_score``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, at):
            names, score = predict(text_arrow(batch.column(at)).to_pylist(), prototypes)
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
