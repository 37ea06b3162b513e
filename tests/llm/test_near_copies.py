"""Near copies against exact similarities of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import DATA
from tidewatch.llm import near_copies, simhash


def shingles_by_hand(text, words=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(one, other):
    return len(one & other) / len(one | other) if one or other else 1.0


def changed(words, share, chance):
    """A copy whose set of shingles is alike in about ``share``."""
    out, n = list(words), len(words)
    least = shingles_by_hand(" ".join(words))
    while jaccard(least, shingles_by_hand(" ".join(out))) > share:
        out[chance.randrange(n)] = f"new{chance.randrange(10**6)}"
    return out


def pairs_of(chance, shares, n, size=400):
    rows = []
    for i in range(n):
        words = [f"w{chance.randrange(3000)}" for _ in range(size + chance.randrange(size))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(words, shares[i % len(shares)], chance)))]
    return rows


def check_kept(rows, kept):
    """Every document that went is alike to one that stayed."""
    sets = {i: shingles_by_hand(t) for i, t in rows}
    for i, _ in rows:
        assert i in kept or any(jaccard(sets[i], sets[j]) >= 0.8 for j in kept), i


def test_fingerprints_and_similarity():
    for text in ["", "One two", "a b c d e f a b c d e", "É é x " * 50]:
        words = text.lower().split() if text.isascii() else re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hashes = [xxhash.xxh64(" ".join(words[i:i + 5]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 4))] if words else []
        want = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        got = near_copies.fingerprints_of(text.encode())
        assert len(got) == 2 and got[0] % (1 << 64) == want
        other = text[: len(text) // 2]
        exact = jaccard(shingles_by_hand(text), shingles_by_hand(other))
        assert near_copies.similarity(near_copies._shingle_set(text.encode(), 5), near_copies._shingle_set(other.encode(), 5)) == exact


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = b" ".join(b"w%d" % (i % 37) for i in range(500))
    whole = near_copies.fingerprints_of(text), near_copies._shingle_set(text, 5).tolist()
    monkeypatch.setattr(near_copies, "_PIECE", 11)
    assert (near_copies.fingerprints_of(text), near_copies._shingle_set(text, 5).tolist()) == whole


def test_recall_at_the_bound_and_above(documents):
    """Pairs made at 0.8, 0.9 and 0.95: of those still at 0.8 or above, 0.9 and more are found; what is unlike stays."""
    rows = pairs_of(random.Random(11), [0.8, 0.9, 0.95, 0.7], 400)
    kept = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, kept)
    sets = {i: shingles_by_hand(t) for i, t in rows}
    found = {0.8: [], 0.85: [], 0.9: []}
    for i in range(0, len(rows), 2):
        alike = jaccard(sets[i], sets[i + 1])
        assert i in kept or i + 1 in kept
        if alike < 0.8:
            assert {i, i + 1} <= kept
        for bound, out in found.items():
            if alike >= bound:
                out.append(not {i, i + 1} <= kept)
    # pairs made down to a share end just below it, so 0.8 and above are those made at 0.9 and 0.95
    assert len(found[0.85]) >= 150 and np.mean(found[0.85]) >= 0.95 and np.mean(found[0.8]) >= 0.9


def test_recall_near_the_bound(documents):
    """Made to lie between 0.8 and 0.83, the hardest pairs."""
    chance, rows = random.Random(5), []
    for i in range(200):
        words = [f"w{chance.randrange(3000)}" for _ in range(500)]
        copy, last = words, words
        while jaccard(shingles_by_hand(" ".join(words)), shingles_by_hand(" ".join(copy))) >= 0.8:
            last, copy = copy, list(copy)
            copy[chance.randrange(500)] = f"new{chance.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(last))]
    kept = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, kept)
    assert len(rows) - len(kept) >= 0.8 * 200


def test_a_chain_keeps_what_is_unlike(documents):
    """Each document is alike to the next one only: a group by links would leave a single one."""
    chance, words = random.Random(2), [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        words = changed(words, 0.88, chance)
    sets = {i: shingles_by_hand(t) for i, t in rows}
    assert jaccard(sets[0], sets[11]) < 0.4
    kept = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, kept)
    assert 3 <= len(kept) <= 8


def test_a_large_group_leaves_one(documents):
    chance, words = random.Random(3), [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(changed(words, 0.96, chance))) for i in range(300)]
    kept = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, kept)
    assert len(kept) == 1


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "few words"), (5, "Few WORDS"), (6, "few other"), (7, "same text of the two rows here"), (7, "same text of the two rows here"),
            (None, "same text of the two rows here"), (8, "the mat " * 30_000), (9, "the mat " * 30_001)]
    out = near_copies.dedup(documents(rows))
    assert out.columns == documents([]).columns
    texts = sorted((r.text or "").strip().lower()[:12] for r in out.collect())
    assert texts == ["", "few other", "few words", "same text of", "the mat the "]
    assert near_copies.dedup(documents([])).count() == 0


def test_small_parts_give_the_same(documents, monkeypatch):
    rows = pairs_of(random.Random(4), [0.9], 40)
    want = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    monkeypatch.setattr(simhash, "PART", 4)
    monkeypatch.setattr(near_copies, "PART", 4)
    got = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, got)
    assert len(rows) - len(got) >= 0.9 * (len(rows) - len(want))


def test_keys_grow_with_the_logarithm_of_the_rows():
    """Of 64 bits cut for four differences, and for near copies: a cell's share stays bounded, copies stay few."""
    copies = []
    for count in (10**3, 10**6, 10**8, 10**9, 10**10, 10**11):
        blocks, of = simhash.plan(count, 4)
        assert blocks - 4 == of and count / 2 ** (64 * of // blocks) <= 2 * simhash.PART
        copies.append(len(simhash.keys_of(simhash.F.lit(1), blocks, of)))
        assert count / 2 ** (64 * near_copies.blocks_in_key(count) // near_copies.BLOCKS) <= 2 * simhash.PART
    assert copies == [5, 5, 15, 15, 15, 35]


def _group(n, chance):
    """(doc_id, text) of one large group of near copies, no two alike word by word."""
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join(changed(words, 0.9, chance))) for i in range(n)]


def _prints(documents, rows):
    found = near_copies.fingerprints(documents(rows)).select(near_copies.F.col("doc_id").alias("node"), "fp0", "fp1")
    return near_copies.settle(found)


def test_candidates_do_not_depend_on_the_size_of_table_or_parts(documents, monkeypatch):
    """Neither longer keys for more rows nor cells cut into parts change what meets; a group's candidates do not grow with the parts."""
    prints = _prints(documents, pairs_of(random.Random(6), [0.9, 0.82], 30) + [(100 + i, t) for i, t in _group(150, random.Random(8))])
    want = sorted(map(tuple, near_copies.candidates(prints).collect()))
    assert len(want) > 150
    for part in (8, 3):
        monkeypatch.setattr(simhash, "PART", part)
        assert sorted(map(tuple, near_copies.candidates(prints).collect())) == want
    monkeypatch.setattr(simhash, "PART", 4096)
    monkeypatch.setattr(type(prints), "count", lambda self: 10**10)
    assert sorted(map(tuple, near_copies.candidates(prints).collect())) == want


def test_groups_are_the_components_joined_by_few_rows(spark, documents, monkeypatch):
    """The same names as all candidates at once give, while stars are made of one row a document and what connects trees."""
    chance = random.Random(9)
    made = [(a, chance.randrange(max(0, a - 40), a)) for a in range(1, 300) for _ in range(chance.randrange(4))]
    made += [(1000 + a, 1000 + b) for a in range(3, 120) for b in range(3)] + [(2000 + a, 2000 + a - 1) for a in range(1, 60)]
    edges = near_copies.settle(spark.createDataFrame(sorted(set(made)), "a long, b long"))
    want = sorted(map(tuple, simhash.components(edges).collect()))
    sizes = []

    def counted(rows):
        sizes.append(rows.where("a <> b").distinct().count())
        return simhash.components(rows)

    monkeypatch.setattr(near_copies, "components", counted)
    assert sorted(map(tuple, near_copies.groups(edges).collect())) == want
    assert sizes[0] == len({a for a, _ in made}) and sizes[1] < sizes[0] / 2 < len(set(made)) / 2
    assert near_copies.groups(edges.limit(0)).count() == 0


def _rows_of_joins_by_a(df):
    """Rows that the joins of two columns ``a`` made while ``df`` was computed, one number a join."""
    df.collect()
    plans, rows = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        elif re.search(r"Join( .*)? \[a#\d+L?\], \[a#\d+L?\]", plan.simpleString(100)):
            rows.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children().iterator()
        while children.hasNext():
            plans.append(children.next())
    return rows


def test_joins_by_document_make_a_row_each(spark, monkeypatch):
    """Names of trees, texts and what is left are joined to a document once, not to each of its candidates."""
    n, each = 200, 8
    made = [(a, b) for a in range(1, n) for b in range(max(0, a - each), a)] + [(1000 + a, 1000 + a - 1) for a in range(1, n)]
    edges = near_copies.settle(spark.createDataFrame(made, "a long, b long"))
    documents = len({a for a, _ in made})
    assert len(made) > 4 * documents
    nodes = sorted({x for pair in made for x in pair})
    texts = {x: f"one two three four five {x // each}" for x in nodes}
    alike = near_copies.alike(edges, spark.createDataFrame([(x, bytearray(t.encode())) for x, t in texts.items()], "node long, bytes binary"))
    assert _rows_of_joins_by_a(alike) == [documents]
    assert sorted(map(tuple, alike.collect())) == sorted((a, b) for a, b in made if texts[a] == texts[b])
    kept = [x for x in nodes if x % 3]
    among = near_copies._among(edges, spark.createDataFrame([(x,) for x in kept], "node long"))
    assert _rows_of_joins_by_a(among) == [len({a for a, _ in made if a % 3})]
    assert sorted(map(tuple, among.collect())) == sorted((a, b) for a, b in made if a % 3 and b % 3)
    stars = []
    monkeypatch.setattr(near_copies, "components", lambda rows: stars.append(rows) or simhash.components(rows))
    near_copies.groups(edges)
    assert _rows_of_joins_by_a(stars[1]) == [documents]


def _padded(words):
    """A phrase repeated so often that it alone makes the fingerprints, while it is one shingle of the set."""
    return " ".join(["pad"] * 800 + words)


def test_documents_hidden_behind_a_smaller_one_are_compared(documents):
    """All three have the same fingerprints; the least is alike to none, the others to each other."""
    one, other = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, _padded(one)), (2, _padded(other)), (3, _padded([*other[:-1], "c"]))]
    assert len({tuple(near_copies.fingerprints_of(t.encode())) for _, t in rows}) == 1
    kept = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, kept)
    assert len(kept) == 2 and 1 in kept


def test_no_two_that_meet_and_are_alike_stay(documents):
    """Windows of one row of words, all of the same fingerprints: each is alike to its neighbours, what goes is alike to one that stays."""
    chance = random.Random(12)
    places = [chance.randrange(300) for _ in range(60)]
    rows = [(i, _padded([f"w{p + k}" for k in range(60)])) for i, p in enumerate(places)]
    sets = {i: shingles_by_hand(t) for i, t in rows}
    kept = {r.doc_id for r in near_copies.dedup(documents(rows)).collect()}
    check_kept(rows, kept)
    assert not [(i, j) for i in kept for j in kept if i < j and jaccard(sets[i], sets[j]) >= 0.8]


def test_all_candidates_are_those_that_agree_in_two_blocks(spark, documents, monkeypatch):
    """Against every pair, once each, in cells of any number of parts; only what cannot be alike is left out."""
    rows = pairs_of(random.Random(13), [0.9, 0.82], 20, 100) + [(100 + i, t) for i, t in _group(50, random.Random(14))]
    sets = {i: shingles_by_hand(t) for i, t in rows}
    prints = {i: [p % (1 << 64) for p in near_copies.fingerprints_of(t.encode())] for i, t in rows}
    edges = [round(i * 64 / 9) for i in range(10)]

    def meet(x, y):
        if (x[0] ^ y[0]).bit_count() > 16 or sum((p ^ q).bit_count() for p, q in zip(x, y)) > 28:
            return False
        return any(sum((p ^ q) >> a & ((1 << (b - a)) - 1) == 0 for a, b in zip(edges, edges[1:])) >= 2 for p, q in zip(x, y))

    every = {(i, j) for i in prints for j in prints if j < i and meet(prints[i], prints[j])}
    alike = {(i, j) for i, j in every if jaccard(sets[i], sets[j]) >= 0.8}
    texts = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "node long, bytes binary")
    found = near_copies.settle(_prints(documents, rows).join(near_copies.outlines(texts), "node"))
    for part in (4096, 8):
        monkeypatch.setattr(simhash, "PART", part)
        assert {tuple(r) for r in near_copies.all_candidates(found, least=0.0).collect()} == every
        got = [tuple(r) for r in near_copies.all_candidates(found).collect()]
        assert len(got) == len(set(got)) and alike <= set(got) <= every
    some = near_copies.F.col("node") < 110
    across = {tuple(r) for r in near_copies.all_candidates(found.where(some), found.where(~some), least=0.0).collect()}
    assert across == {(i, j) for i, j in every if (i < 110) != (j < 110)}


def test_real_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in near_copies.dedup(docs).collect()}
    check_kept(rows, kept)
    sets = [(i, shingles_by_hand(t)) for i, t in rows]
    alike = [(i, j) for n, (i, s) in enumerate(sets) for j, t in sets[:n] if jaccard(s, t) >= 0.8]
    assert np.mean([not {i, j} <= kept for i, j in alike]) >= 0.9
