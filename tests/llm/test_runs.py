"""Periodic runs against brute force."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA
from tidewatch.llm import periodic_runs, queries


def runs_by_hand(words, repeats=4, least=6):
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end + q - at
            if end > at and size >= max(least, repeats * q):
                stretch = words[at:end + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((at, size, q))
            at = end + 1 if end == at else end
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_by_hand(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def words_by_hand(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 5)])
def test_random_words(chance, repeats, least):
    for _ in range(300):
        letters, docs = chance.choice([1, 2, 3, 5]), []
        for _ in range(chance.randint(1, 4)):
            words = [chance.randrange(letters) for _ in range(chance.randint(0, 60))]
            if words and chance.random() < 0.6:
                a = chance.randrange(len(words))
                p = 1 + (len(words) - a) // chance.randint(3, 10)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            docs.append(words)
        flat = np.array([d * letters + w for d, words in enumerate(docs) for w in words], np.int64)
        bounds = np.append(0, np.cumsum([len(w) for w in docs]))
        got = periodic_runs.runs_of(flat, np.repeat(bounds[1:], np.diff(bounds)), repeats, least)
        assert list(map(tuple, got.tolist())) == [(s + b, n, q) for w, b in zip(docs, bounds) for s, n, q in runs_by_hand(w, repeats, least)]


def test_suffix_neighbours_share_as_many_words_as_counted(chance):
    words = np.array([chance.randrange(3) for _ in range(200)], np.int64)
    levels = periodic_runs.doubled_ranks(words, np.full(200, 200))
    order = np.argsort(levels[-1])
    suffixes = [tuple(words[i:].tolist()) for i in order]
    assert len(set(levels[-1].tolist())) == 200
    got = periodic_runs.common_words(levels, order[:-1], order[1:])
    for a, b, n in zip(suffixes, suffixes[1:], got):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (5, "x\na\u00a0b a\u00a0b\ta\u00a0b a\u00a0b a\u00a0b a\u00a0b y"),
        (6, "the mat " * 30_000), (None, "b c b c b c b c"), (7, "a a a a a"), (8, "Ab ab " * 4 + "q"), (9, "z " * 7 + "é z " * 5)]


def test_documents(documents):
    got = periodic_runs.collapse(documents(ROWS).repartition(2)).collect()
    assert len(got) == len(ROWS)
    want = []
    for doc, text in ROWS:
        words = words_by_hand(text)
        runs = [(0, 60_000, 2)] if doc == 6 else runs_by_hand(words)
        want.append((doc, len(words), runs, "the mat" if doc == 6 else " ".join(kept_by_hand(words, runs))))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic_runs.collapse(documents([])).count() == 0


def test_long_texts_are_split_in_pieces(monkeypatch):
    text = b"ab  cd\nef " * 50
    monkeypatch.setattr(periodic_runs, "_PIECE", 7)
    known = {}
    numbers = periodic_runs.word_numbers(text, known)
    assert [list(known)[i] for i in numbers] == text.split() and len(known) == 3


def test_query_against_brute_force(spark):
    docs = {r.doc_id: words_by_hand(r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = queries.op11_periodic_runs(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        words, h = docs[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        runs = runs_by_hand(words) if n < 1500 or h % 10 == 0 else [
            tuple(x) for x in periodic_runs.runs_of(np.unique(words, return_inverse=True)[1], np.full(n, n)).tolist()]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept_by_hand(words, runs)))
    assert planted > 5


def test_strongest_run_and_planted_tails(spark):
    rows = [([(0, 8, 2), (3, 12, 3), (9, 8, 2)],), ([(5, 7, 1), (5, 70, 10)],), ([],)]
    frame = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>")
    got = [r.b and tuple(r.b) for r in frame.select(periodic_runs.strongest(F.col("runs")).alias("b")).collect()]
    assert got == [(0, 8, 2), (5, 7, 1), None]
    key = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = spark.createDataFrame([(key, None), (key, " "), (key, "one"), (None, "a b")], "k long, t string")
    assert [r.t for r in texts.select(periodic_runs.repeat_tail(F.col("t"), F.col("k")).alias("t")).collect()] == [None, " ", "one", "a b"]
