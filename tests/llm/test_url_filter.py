"""URL rules against brute force, the model on names that it has not seen."""

import re

import numpy as np
import pytest

from tests.llm.conftest import DATA
from tidewatch.llm import queries, url_filter
from tidewatch.llm.url_filter import Rule


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_by_hand(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"), default=None)


@pytest.fixture(scope="module")
def model():
    rows = [(*parts_by_hand(u), v == "block") for u, v in url_filter.LABELLED]
    return url_filter.fit(*zip(*rows))


def test_rules(chance):
    hosts = ["a", "b.a", "c.b.a", "ba", "com", "x.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "x"]
    for _ in range(200):
        rules = [Rule(chance.choice(["allow", "block"]), chance.choice(hosts[:-1]), chance.choice(paths)) for _ in range(chance.randint(0, 8))]
        listed = url_filter.Rules(rules)
        for host in [*hosts, "y.x.com", "xcom"]:
            for path in paths:
                assert listed.judge(host, path) == rule_by_hand(host, path, rules)


def test_unseen_names(model):
    bad = ["http://www.mega-casino.net/en/5", "https://poker-bets.org/de/", "http://m.online-pills.com/fr/1", "https://blog.ad-banners.org/", "http://adult-xxx.net/"]
    good = ["http://www.piano-lessons.net/en/5", "https://geology.org/de/", "http://m.swimming.com/fr/1", "https://blog.cathedral.org/", "http://mathematics.net/"]
    for urls, blocked in ((bad, True), (good, False)):
        hosts, paths = zip(*map(parts_by_hand, urls))
        assert ((model.scores(list(hosts), list(paths)) >= url_filter.CUT) == blocked).all()


def test_names_left_out_are_told_apart():
    """Every fifth name of either kind is held out, with all its fronts and ends."""
    rows = [(*parts_by_hand(u), v == "block", n // 4 % 5 == 0) for v in ("block", "allow")
            for n, u in enumerate(u for u, w in url_filter.LABELLED if w == v)]
    model = url_filter.fit(*zip(*[r[:3] for r in rows if not r[3]]))
    held = [r for r in rows if r[3]]
    scores = model.scores([r[0] for r in held], [r[1] for r in held])
    assert np.mean((scores >= 0.5) == np.array([r[2] for r in held])) >= 0.75


def test_training_does_not_depend_on_order(model, chance, spark):
    rows = list(url_filter.LABELLED)
    chance.shuffle(rows)
    again = url_filter.learn(url_filter.labelled_table(spark, [*rows, *rows[:5], (None, "block"), ("http://x", "maybe")]))
    assert again.offset == model.offset and (again.weights == model.weights).all()
    few = url_filter.learn(url_filter.labelled_table(spark), sample=20)
    assert 0 < np.count_nonzero(few.weights) < np.count_nonzero(model.weights)


def test_features_by_hand():
    hosts, paths = ["ab.c", "", "ab.c"], ["/x", "", "/é"]
    place, bucket = url_filter.features(hosts, paths)
    for i, (h, p) in enumerate(zip(hosts, paths)):
        n = sum(max(0, len(part) + 2 - size + 1) for part in (h, p) for size in url_filter.SIZES)
        assert (place == i).sum() == n
        alone = url_filter.features([h], [p])[1]
        assert sorted(alone.tolist()) == sorted(bucket[place == i].tolist())
    assert set(url_filter.features(["abcdef"], [""])[1]).isdisjoint(url_filter.features([""], ["abcdef"])[1])


URLS = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "http://example.com"), (5, "http://example.com"), (None, "http://a.net/es/"),
        (6, "http://É.Net?q=/es/"), (7, "x://a://b/c"), (8, "://"), (9, "http://com/\n/en"), (10, "http://h.net/fr/" + "y" * 200_000), (11, "http://a.net#/fr/")]


def test_documents(spark, model):
    frame = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in URLS], "page_id long, url string, host string, score string, rule string")
    got = url_filter.judge(frame.repartition(2), queries.URL_RULES, model).collect()
    want = []
    for i, url in URLS:
        host, path = parts_by_hand(url)
        rule = rule_by_hand(host, path, queries.URL_RULES)
        score = float(model.scores([host], [path])[0])
        want.append((i, host, path, rule and rule.name, rule.verdict if rule else "block" if score >= 0.5 else "allow", round(score, 9)))
    assert sorted(((*r[:5], round(r[5], 9)) for r in got), key=repr) == sorted(want, key=repr)
    assert url_filter.judge(frame.limit(0), queries.URL_RULES, model).count() == 0


def test_models_without_both_verdicts(spark):
    none = url_filter.learn(url_filter.labelled_table(spark, []))
    blocked = url_filter.learn(url_filter.labelled_table(spark, [("http://a", "block")]))
    assert none.scores(["a"], ["/"])[0] < 1e-9 and blocked.scores(["a"], ["/"])[0] > 1 - 1e-9


def test_query_against_brute_force(spark, model):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    got = queries.op13_url_filter(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = parts_by_hand(pages[r.page_id])
        rule = rule_by_hand(host, path, queries.URL_RULES)
        method = "block" if model.scores([host], [path])[0] >= url_filter.CUT else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.name, rule.verdict if rule else method)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
