"""Fingerprints, the Gray-order index and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tidewatch.llm import simhash

POPULAR = "the words of a long enough text that others copy with one change at some place or at none"


def print_by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_hand(prints, max_bits=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in ["", None, " \t\n", "one", "ONE two", "a b c", "a b c d", "a b c d e", "É é \x0b x y z É", POPULAR * 50]:
        assert simhash.fingerprint((text or "").encode()) == print_by_hand(text)


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.array([i ^ i >> 1 for i in range(1 << 10)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1 << 10)).all()


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300, 1000])
def test_index_finds_all_pairs(n):
    random = np.random.default_rng(n)
    centre = random.integers(0, 1 << 63, max(1, n // 20), np.uint64)
    fp = random.choice(centre, n)
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << random.integers(0, 64, n).astype(np.uint64))
    fp = np.unique(fp)
    group = np.sort(random.integers(0, 3, len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    found = {(int(a), int(b)) for x, y in simhash.linked_pairs(fp, group, 4) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp))
            if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 4}
    assert found == want


@pytest.mark.parametrize("part", [4096, 8])
def test_components_of_fingerprints(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)  # small parts: large cells are cut
    random = np.random.default_rng(3)
    centre = random.integers(0, 1 << 63, 12, np.uint64)
    fp = np.concatenate([centre[:6], random.choice(centre, 150)])
    for _ in range(3):
        fp = np.where(random.random(len(fp)) < 0.8, fp ^ (np.uint64(1) << random.integers(0, 64, len(fp)).astype(np.uint64)), fp)
    chain = [np.uint64((1 << 4 * i) - 1) for i in range(15)]  # steps of four bits
    fp = np.unique(np.concatenate([fp, np.array(chain, np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    star = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    got = [star.get(int(x), int(x)) for x in fp.view(np.int64)]
    by_hand = roots_by_hand([int(x) for x in fp])
    for i in range(len(fp)):
        for j in range(i):
            assert (got[i] == got[j]) == (by_hand[i] == by_hand[j])


def test_documents(documents):
    rows = [(5, POPULAR * 9), (3, POPULAR.upper() * 9), (9, POPULAR * 9 + " more"), (None, POPULAR * 9), (20, None), (21, ""), (22, " \n"),
            (30, "quite another text without any likeness to the rest"), (31, "one"), (31, "one"), (40, "long " * 30_000)]
    got = simhash.assign(documents(rows)).collect()
    prints = [print_by_hand(t) for _, t in rows]
    roots = roots_by_hand(prints)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        want.append((doc, prints[i], min(ids)))
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    left = simhash.dedup(documents(rows))
    assert left.columns == documents([]).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({w[2] for w in want})


def test_empty_table(documents):
    assert simhash.assign(documents([])).count() == 0
    assert simhash.dedup(documents([])).count() == 0
