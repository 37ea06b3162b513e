"""Toxicity scores of texts read through a noisy channel.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``, ``i.d.i.o.t``) and repetition
(``idiooot``, ``iddiot``). A token of any length that shows such marks becomes a lattice: every observed character may stand for
its letters, marks between letters for nothing, and a run for one or two letters, at a price. Viterbi
search under a trigram language model of letters finds the cheapest reading (states are the last two
letters, so the search is exact), and the reading is scored beside the token itself. Marks at a token's
ends that may stand for letters (``$tupid``) are read too. Three or more short pieces in a row become one
lattice in which any white space is skipped at a price or ends a word; what all paths agree on is written
out, so lattices have no largest size.

Evidence: whole words and word beginnings of four to six letters, learned from labelled documents as
the lower bound of their log odds; a document has the sum over its distinct tokens' strongest
evidence, turned into a probability by a logistic curve fitted on documents not used for that evidence.

Evidence and curve are learned from at most about ``sample`` documents of each label, chosen by a hash of
the id; the model keeps all features whose likelihood ratio statistic is at least ``MIN_GAIN``. The language
model counts the trigrams of all rows, labelled or not, and keeps all of them.

Defined results: null and empty texts have no evidence and get the curve's value at zero; with no
learning documents of one of the labels every score is 0.5; repeated labels count once (toxic if any
is); repeated rows get equal results; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settle, slices, text_arrow

SAMPLE = 10_000
MIN_GAIN = 16.0  # likelihood ratio statistic of a feature
CUT = 0.7
SATURATION = 12.0

# What characters may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

SUBSTITUTE, SKIP, COLLAPSE = 0.7, 0.5, 0.3
JOINS = (0.5, 1.5, 3.0)  # prices of a skipped white space; spaced pieces are read at each of them
MARKS = "".join(c for c in PUNCTUATION if c not in LEET)  # stand for nothing, so none is needed at the ends
_PIECE = re.compile(r"(\S)\1*+[^\w\s]*+|\S\S")  # one character with repetitions and marks, or any two
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")
_CACHE = 300_000
_AGREE = 64  # letters gathered before those that all paths share are written out
_REMEMBER = 128  # longer tokens hardly come again


def single(form: str) -> str:
    """Every run of a character as one."""
    return _RUN.sub(r"\1", form)


@dataclass
class Model:
    features: dict[str, float] = field(default_factory=dict)
    trigrams: dict[str, int] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = 0.0
    pairs: Counter = field(default_factory=Counter)
    ones: Counter = field(default_factory=Counter)
    known: dict[str, float] = field(default_factory=dict)
    logs: dict[str, float] = field(default_factory=dict)

    def prepare(self) -> Model:
        self.pairs, self.ones, middle = Counter(), Counter(), Counter()
        for t, n in self.trigrams.items():
            self.pairs[t[:2]] += n
            self.ones[t[0]] += n
            middle[t[1:]] += n
        self.suffix_pairs, self.letters = middle, max(2, len(self.ones))
        bare = {single(f) for f in self.features}
        self.whole, self.parts = {f[1:] for f in bare if f[0] == "="}, {f for f in bare if f[0] != "="}
        self.stems = {f[:n] for f in self.whole | self.parts for n in range(1, len(f) + 1)}
        return self

    def may_hold(self, form: str) -> bool:
        """False only if neither a token nor any reading of it has a feature, so that it need not be read.

        With runs as one character, what has been read so far must begin a feature.
        """
        stems, parts = self.stems, self.parts
        if form.isalpha():
            said = ""
            for char in form:
                if said[-1:] != char:
                    said += char
                    if said not in stems:
                        return False
                    if said in parts:
                        return True
            return said in self.whole
        live = {""}
        for char in form:
            fresh = set() if char.isalpha() else set(live)
            for said in live:
                for x in char + LEET.get(char, ""):
                    more = said if said[-1:] == x else said + x
                    if more in stems:
                        if more in parts:
                            return True
                        fresh.add(more)
            if not fresh:
                return False
            live = fresh
        return not live.isdisjoint(self.whole)

    def log_p(self, before: str, letter: str) -> float:
        if (value := self.logs.get(before + letter)) is not None:
            return value
        if len(self.logs) >= _CACHE:
            self.logs.clear()
        value = self.logs[before + letter] = self._log_p(before, letter)
        return value

    def _log_p(self, before: str, letter: str) -> float:
        b = before[1]
        backed = (self.suffix_pairs.get(b + letter, 0) + 0.1) / (self.ones.get(b, 0) + 0.1 * self.letters)
        return math.log((self.trigrams.get(before + letter, 0) + 2 * backed) / (self.pairs.get(before, 0) + 2))


def read_token(token: str, model: Model, join: float = SKIP) -> str:
    """The most likely reading of an observed token: exact Viterbi over its lattice.

    White space is skipped at the price ``join`` or ends a word, which the reading shows as a space.
    """
    states, agreed = {"^^": (0.0, "")}, []
    for char, run in groupby(token, lambda c: " " if c.isspace() else c):
        n = sum(1 for _ in run)
        readings = [(char, 0.0)] if char.isalpha() else []
        readings += [(x, SUBSTITUTE) for x in LEET.get(char, "")]
        if char == " ":
            readings.append(("", join))
        elif not char.isalpha():
            readings.append(("", SKIP if char not in LEET or not char.isdigit() else 4 * SKIP))
        fresh: dict[str, tuple[float, str]] = {}
        for before, (cost, said) in states.items():
            for letter, price in readings:
                for times in {1, min(n, 2)} if letter else {0}:
                    last, total = before, cost + price + (COLLAPSE if letter and times < n else 0)
                    for _ in range(times):
                        total -= model.log_p(last, letter)
                        last = last[1] + letter
                    if last not in fresh or (total, said) < fresh[last]:
                        fresh[last] = (total, said + letter * times)
            if char == " " and before != "^^":
                total = cost - model.log_p(before, "$")
                if "^^" not in fresh or (total, said) < fresh["^^"]:
                    fresh["^^"] = (total, said + " ")
        states = fresh
        if max(len(said) for _, said in states.values()) > _AGREE:
            shared = commonprefix([said for _, said in states.values()])
            agreed.append(shared)
            states = {last: (cost, said[len(shared):]) for last, (cost, said) in states.items()}
    return "".join(agreed) + min((cost - model.log_p(last, "$"), said) for last, (cost, said) in states.items())[1]


def suspicious(core: str) -> bool:
    """Whether a token may be read otherwise than it stands: marks, digits and repeated letters beside letters."""
    if core.isalpha():
        return _DOUBLE.search(core) is not None
    return any(c.isalpha() for c in core)


def features_of(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in (4, 5, 6) if len(word) >= n]]


def is_piece(token: str) -> bool:
    return len(token) < 3 or (token[1] == token[0] or not token[1].isalnum()) and _PIECE.fullmatch(token) is not None


def spaced(tokens: list[str], distinct: set[str]) -> list[list[str]]:
    """All longest runs of three or more pieces, in the order of the tokens."""
    short = set(filter(is_piece, distinct))
    marks = bytes(map(short.__contains__, tokens))
    runs, start = [], marks.find(b"\1\1\1")
    while start >= 0:
        end = marks.find(b"\0", start)
        end = len(marks) if end < 0 else end
        runs.append(tokens[start:end])
        start = marks.find(b"\1\1\1", end)
    return runs


def words_of(text: str) -> set[str]:
    """Words without marks at their ends, and spaced pieces glued: what is learned from."""
    tokens = text.lower().split()
    distinct = set(tokens)
    found = {t.strip(PUNCTUATION) for t in distinct}
    found.update(map("".join, spaced(tokens, distinct)))
    found.discard("")
    return found


def plain(token: str) -> bool:
    return token.isalpha() and not _TRIPLE.search(token)


def evidence(token: str, model: Model) -> float:
    """Of a token as it stands: the strongest of its forms without marks at the ends and with those that may be letters."""
    if (value := model.known.get(token)) is not None:
        return value
    words, core = set(), token.strip(PUNCTUATION)
    for form in {core, token.strip(MARKS)}:
        if form and model.may_hold(form):
            if form == core:
                words.add(core)
            if suspicious(form):
                words.add(read_token(form, model))
    return _remember(token, words, model)


def run_evidence(pieces: list[str], model: Model) -> float:
    """Of spaced pieces: the strongest word of their readings, or all of them glued."""
    token = " ".join(pieces)
    if (value := model.known.get(token)) is not None:
        return value
    words = {"".join(pieces)}
    if suspicious(token):
        words.update(w for join in JOINS for w in read_token(token, model, join).split())
    return _remember(token, words, model)


def _remember(token: str, words: set[str], model: Model) -> float:
    value = max((model.features.get(f, 0.0) for w in words for f in features_of(w)), default=0.0)
    if len(token) <= _REMEMBER:
        if len(model.known) >= _CACHE:
            model.known.clear()
        model.known[token] = value
    return value


def total_evidence(text: str, model: Model) -> float:
    tokens = text.lower().split()
    distinct, best = set(tokens), {}
    known = model.known.get
    for token in distinct:
        value = known(token)
        if value is None:
            value = evidence(token, model)
        if value:
            core = token.strip(PUNCTUATION) or token
            best[core] = max(value, best.get(core, 0.0))
    for pieces in spaced(tokens, distinct):
        core = "".join(pieces)
        best[core] = max(run_evidence(pieces, model), best.get(core, 0.0))
    return min(SATURATION, math.fsum(best.values()))


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, fold) -> documents with a feature by label and fold."""
    counts: dict[str, list[int]] = {}

    def out():
        keys = list(counts)
        columns = np.array([counts[k] for k in keys], np.int64).reshape(len(keys), 4).T
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *map(pa.array, columns)], ["key", "c0", "c1", "c2", "c3"])

    for batch in slices(batches, 1000, 0):
        texts, toxic, fold = text_arrow(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, t, f in zip(texts, toxic, fold):
            at = 2 * f + t
            for key in {x for w in words_of(text) for x in features_of(w)}:
                counts.setdefault(key, [0, 0, 0, 0])[at] += 1
            if len(counts) > 200_000:
                yield out()
                counts = {}
    if counts:
        yield out()


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> partial sums of trigrams; a token, marks included, counts once for each row that has it."""
    tokens: Counter[str] = Counter()

    def out():
        counts: Counter[str] = Counter()
        for t, n in tokens.items():
            w = t.strip(PUNCTUATION)
            if plain(w):
                padded = f"^^{w}$"
                for i in range(len(padded) - 2):
                    counts[padded[i:i + 3]] += n
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    for batch in slices(batches, 1000, 0):
        for text in text_arrow(batch.column(0)).to_pylist():
            tokens.update(set(text.lower().split()))
            if len(tokens) > 200_000:
                yield out()
                tokens.clear()
    if tokens:
        yield out()


def gain(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio statistic of a feature in ``a`` toxic and ``b`` clean documents of all of them."""
    share, n = toxic / max(1, toxic + clean), a + b
    part = lambda x, p: F.when((x > 0) & F.lit(p > 0), x * F.log(x / (n * F.lit(p or 1.0)))).otherwise(0.0)
    return 2 * (part(a, share) + part(b, 1 - share))


def _strength(a: int, b: int, toxic: int, clean: int) -> float:
    """Lower bound of the log odds of a feature, 0 if it is too weak."""
    lift = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    share = toxic / max(1, toxic + clean)
    gain = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)) if a else 0
    bound = lift - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return bound if gain >= MIN_GAIN and bound > 0 else 0.0


def _curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (evidence, toxic, documents), slightly regularised."""
    x, y, n = (np.array(c, float) for c in zip(*points))
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * p * 1.0) - design.T @ (y * 1.0) + 1e-2 * w * [1, 0]
        hess = design.T @ (design * (n * p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic)."""
    marked = settle(
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model().prepare()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    limit = F.when(F.col("toxic") == 1, (sample << 20) / sizes[1]).otherwise((sample << 20) / sizes[0])
    # About 2 x sample ids at most, however many labels there are: small enough to send to all tasks.
    ids = marked.where((draw < limit) & F.col("toxic").isin(0, 1)).select(
        "doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", "fold")
    each = [{(r.toxic, r.fold): r.n for r in ids.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}.get((t, f), 0)
            for f in (0, 1) for t in (0, 1)]
    counted = settle(
        chosen.mapInArrow(_counts, "key string, c0 long, c1 long, c2 long, c3 long").groupBy("key")
        .agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)]).where("c1 + c3 >= 3")
    )
    both = F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")
    # one row a distinct trigram: as many as the alphabets in use allow, however many rows there are
    trigrams = {r.key: r.n for r in docs.select("text").mapInArrow(_trigrams, "key string, n long").groupBy("key").agg(
        F.sum("n").alias("n")).collect()}
    share = (F.col("c1") + F.col("c3")) / both  # only features toxic documents have more often
    # what neither the first fold nor both folds make strong enough; the sample bounds what is left
    strong = (gain(F.col("c1"), F.col("c0"), each[1], each[0]) >= MIN_GAIN - 1e-6) | (
        gain(F.col("c1") + F.col("c3"), F.col("c0") + F.col("c2"), each[1] + each[3], each[0] + each[2]) >= MIN_GAIN - 1e-6)
    rows = counted.where((share > (each[1] + each[3]) / max(1, sum(each))) & strong).orderBy("key").collect()

    def strengths(count, toxic, clean):
        found = ((r.key, _strength(*count(r), toxic, clean)) for r in rows)
        return {k: v for k, v in found if v > 0}

    trial = Model(strengths(lambda r: (r.c1, r.c0), each[1], each[0]), trigrams)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial.prepare()
        for batch in slices(batches, 1000, 0):
            z = [round(total_evidence(t, trial), 1) for t in text_arrow(batch.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column(1)], ["z", "toxic"])

    curve = chosen.where("fold = 1").mapInArrow(weigh, "z double, toxic int").groupBy("z").agg(
        F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("z").collect()
    slope, offset = _curve([(r.z, r.y, r.n) for r in curve]) if curve else (0.0, 0.0)
    return Model(strengths(lambda r: (r.c1 + r.c3, r.c0 + r.c2), each[1] + each[3], each[0] + each[2]), trigrams, slope, offset).prepare()


def probability(z: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * z + model.offset))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, evidence, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, 1):
            z = [total_evidence(t, model) for t in text_arrow(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(z, pa.float64()), pa.array([probability(x, model) for x in z], pa.float64())],
                ["doc_id", "evidence", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, evidence double, score double")
