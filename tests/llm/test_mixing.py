"""The mix against the stated rule, step by step."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import mixing


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """source -> target: shares by weight, stopped at the limit, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), share * sum(sizes.values())
    while True:
        room = left - sum(limit * sizes[s] for s in full)
        whole = sum(weight[s] for s in order if s not in full)
        target = {s: limit * sizes[s] if s in full else room * weight[s] / whole for s in order}
        above = {s for s in order if s not in full and target[s] > limit * sizes[s]}
        if not above:
            return target
        full |= above


def rows_of(chance, n=300):
    sources = ["a", "b", "B", "é", "z", "", None, "hot"]
    out = [(i, "w " * chance.randint(0, 30), "en", chance.choice(sources + ["hot"] * 6)) for i in range(n)]
    return out + [(None, "x y", "en", "a"), (7, None, "en", "a"), (7, "same id", "en", None), (9, "t\tu\nv\x0bw\x0cx\ry é", "en", "b")]


@pytest.mark.parametrize("n", [300, 3])
def test_plan_follows_the_rule(documents, chance, n):
    rows = rows_of(chance, n)
    got = mixing.plan(documents(rows)).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)
        rate = r.target / r.source_size if r.source_size else 0
        named = f"mix-1|{'null' if r.doc_id is None else r.doc_id}".encode()
        u = int(hashlib.md5(named).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate) + (u < rate - int(rate)) <= 2
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_emits_the_planned_copies(documents, chance):
    frame = documents(rows_of(chance))
    planned = Counter()
    for r in mixing.plan(frame).collect():
        planned[r.doc_id] += r.copies
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +planned
    assert sorted(map(repr, mixing.mix(frame).collect())) == sorted(map(repr, mixed.collect()))


def test_sources_come_near_their_targets(spark, documents, chance):
    rows = [(i, "w " * 100, "en", chance.choice("aabc")) for i in range(4000)]
    taken, target = Counter(), {}
    for r in mixing.plan(documents(rows)).collect():
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    for source, n in taken.items():
        assert n == pytest.approx(target[source], rel=0.06)


def test_no_words_and_no_rows(documents):
    assert [r.target for r in mixing.plan(documents([(1, None, "en", "a"), (2, " \n", "en", "b")])).collect()] == [0, 0]
    assert mixing.plan(documents([])).count() == 0
    assert mixing.mix(documents([])).count() == 0
