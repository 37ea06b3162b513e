"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

A URL's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
its path is what follows up to ``?``, ``#`` or the end. A rule (verdict, host, path) fits its host and
all subdomains where the path starts with the rule's; of those that fit the one with the longest host
and path wins (then the longer host, then block). What no rule judges, the model does: n-grams of 3 to 5
code points of host and path, each with marks at its ends, are hashed to buckets; a URL is the vector
of their counts scaled to length one. The model is trained on a small table of labelled URLs, by default
``LABELLED``; of a larger one at most about ``sample`` rows, chosen by a hash of the URL, are learned from.
Rules and model are parameters of bounded size and go to the tasks; pages are judged where they are.

Defined results: null URLs and URLs without ``://`` have an empty host and path, fit no rule and are
judged by the model's offset alone; without learning rows of both verdicts the model's score is the share
of blocked ones (0 without any); ids may be null or of any type; repeated rows get equal results; an empty
table gives no rows; URLs of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, slices, text_arrow

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
SAMPLE = 10_000
CUT = 0.5
PENALTY = 1e-4
ROUNDS = 2000
_HOST, _PATH, _END = 1, 2, 3  # marks around host and path, which no URL holds


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The small labelled table, as names of hosts. Blocked kinds are betting, pills, adult pages, trackers, link farms and traps.
BLOCKED = """
lucky-casino casino-royal online-casino bigwin-slots poker-win win-jackpot sport-bets free-poker bet-now bets-today best-bets
cheap-meds pills-online buy-pills discount-pharma cheap-viagra diet-pills adult-video xxx-adult adult-chat sex-cams hot-xxx adult-dating porn-tube
ads-server click-track ad-track tracker-ads banner-ads track-clicks popup-ads link-farm spam-links seo-spam content-farm spam-mail article-farm
free-gift win-prize free-iphone get-rich-free free-money prize-win-now loan-free
""".split()
ALLOWED = """
daily-news gardener encyclopedia university library bookstore city-museum weather kitchen travel-journal hospital schoolhouse photography running
history-archive railway orchestra science-magazine theatre football-results physics-notes thinkers therapy mother-and-child thirty-songs
northern-light weather-station river-valley stone-house hand-made tennis-club mountains the-others handbook bicycle painting open-source well-being
teacher kindergarten local-farmers-union ancient-greece north-sea
""".split()
_FRONTS = ("", "www.", "blog.", "m.")
_ENDS = (".com/en/", ".net/de/", ".org/fr/", ".com/es/", ".net/en/", ".org/en/", ".com/", ".net", ".org/fr/page.html", ".com/de/1", ".net/es/", ".org/es/20")
# Each name with every front; ends are dealt in turn, so that neither tells the verdict.
LABELLED = [
    (f"http://{front}{name}{_ENDS[(n + 5 * f) % len(_ENDS)]}", verdict)
    for verdict, names in (("block", BLOCKED), ("allow", ALLOWED)) for n, name in enumerate(names) for f, front in enumerate(_FRONTS)
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(hosts: list[str], paths: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(URL's place, bucket) of every n-gram, in no order."""
    marked = [f"{chr(_HOST)}{h}{chr(_END)}{chr(_PATH)}{p}{chr(_END)}" for h, p in zip(hosts, paths)]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    part = np.cumsum((points == _HOST) | (points == _PATH))  # n-grams stay inside a host or a path
    places, found = [], []
    for n in SIZES:
        count = max(0, len(points) - n + 1)
        key = np.full(count, n, np.uint64)
        for k in range(n):
            key = (key ^ points[k:count + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        # the kind of part is in the key of every n-gram, not only of the first one
        key = (key ^ (part[:count] % 2).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = part[:count] == part[n - 1:]
        places.append(owner[:count][inside])
        found.append(((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[inside])
    return np.concatenate(places), np.concatenate(found)


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that a URL is to be blocked."""
        place, bucket = features(hosts, paths, len(self.weights))
        sums, sizes = _sums(place, bucket, self.weights, len(hosts))
        return 1 / (1 + np.exp(-(sums / sizes + self.offset)))


def _sums(place: np.ndarray, bucket: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every URL the product with the weights, and the length of its vector of counts (1 where it is empty)."""
    key, counts = np.unique(place * len(weights) + bucket, return_counts=True)
    size = np.sqrt(np.bincount(key // len(weights), counts.astype(float) ** 2, n))
    return np.bincount(place, weights[bucket], n), np.where(size > 0, size, 1.0)


def fit(hosts: list[str], paths: list[str], blocked: list[bool], buckets: int = BUCKETS) -> Model:
    """Logistic regression with a quadratic penalty by accelerated gradient steps, the same for the same rows in any order."""
    rows = sorted(zip(hosts, paths, map(bool, blocked)))
    y = np.array([b for *_, b in rows], float)
    weights = np.zeros(buckets)
    if not len(rows) or y.min() == y.max():
        return Model(weights, 40.0 if len(rows) and y[0] else -40.0)
    place, bucket = features([h for h, _, _ in rows], [p for _, p, _ in rows], buckets)
    _, size = _sums(place, bucket, weights, len(rows))
    used, at = np.unique(bucket, return_inverse=True)
    w = ahead = np.zeros(len(used) + 1)  # the last one is the offset
    step, value = 1 / (0.25 * 2 + PENALTY), 1 / size[place]
    for t in range(ROUNDS):
        z = np.bincount(place, ahead[at] * value, len(rows)) + ahead[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        slope = np.append(np.bincount(at, error[place] * value, len(used)), error.sum()) + PENALTY * np.append(ahead[:-1], 0)
        fresh = ahead - step * slope
        ahead, w = fresh + t / (t + 3) * (fresh - w), fresh
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def learn(labelled: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """A model from (url, verdict) rows, of which at most about ``sample`` of either verdict are taken."""
    known = labelled.where(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block")).select("url", "verdict").distinct()
    sizes = {r.verdict: r.n for r in known.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("url", F.lit("url-filter")), F.lit(1 << 20))
    limit = F.when(F.col("verdict") == "block", (sample << 20) / sizes.get("block", 1)).otherwise((sample << 20) / sizes.get("allow", 1))
    rows = known.where(draw < limit).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict").collect()
    return fit([r.host for r in rows], [r.path for r in rows], [r.verdict == "block" for r in rows], buckets)


def labelled_table(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(LABELLED if rows is None else rows, "url string, verdict string")


class Rules:
    """Rules by host, the longest first."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.path), r.verdict != "block")):
            self.by_host.setdefault(rule.host, []).append(rule)

    def judge(self, host: str, path: str) -> Rule | None:
        best, suffix = None, host
        while suffix:  # from the whole host to its last label, so of equally long rules the longer host stays
            for rule in self.by_host.get(suffix, ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.name) > len(best.name):
                        best = rule
                    break
            suffix = suffix.partition(".")[2]
        return best


def judge(pages: DataFrame, rules: list[Rule], model: Model, cut: float = CUT) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row of (page_id, url)."""
    listed = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000, 2):
            hosts, paths = (text_arrow(batch.column(i)).to_pylist() for i in (1, 2))
            score = model.scores(hosts, paths)
            found = [listed.judge(h, p) for h, p in zip(hosts, paths)]
            verdict = [r.verdict if r else "block" if s >= cut else "allow" for r, s in zip(found, score.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r.name for r in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parsed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
