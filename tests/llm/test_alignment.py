"""Token alignment against the libraries and brute force; fragments composed in any tree."""

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tests.llm.conftest import DATA
from tidewatch.llm import queries, token_alignment

BITS = ["the", " ", "  ", "\n", "\t", "é", "日本", "ñandú", "'s", "<|endoftext|>", "</s>", "123", "🎉", "\u00a0", "\u3000", " x", "Hello", "!!",
        "antidis", "\r\n", " \n ", "\x1c", "\x00", "ing", "   "]


@pytest.fixture(scope="module")
def vocabularies():
    return token_alignment.load()


@pytest.fixture(scope="module")
def aligner(vocabularies):
    return vocabularies.aligner()


@pytest.fixture(scope="module")
def by_hand(vocabularies, aligner):
    """Groups of a text by the two libraries themselves, each text encoded whole."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_str(vocabularies.a_json)
    library.encode_special_tokens = True

    def groups(text):
        if not text:
            return []
        data, tokens = (" " + text).encode(), []
        for ids, raw in ((library.encode(" " + text, add_special_tokens=False).ids, aligner.a_raw), (aligner.b.encode(text), aligner.b_raw)):
            end, found = 0, []
            for i in ids:
                end += len(raw[i])
                found.append((i, end))
            if b"".join(raw[i] for i in ids) != data:
                return []
            tokens.append(found)
        common, start, out = sorted({e for _, e in tokens[0]} & {e for _, e in tokens[1]}), 0, []
        for end in common:
            out.append(tuple([i for i, e in side if start < e <= end] for side in tokens))
            start = end
        return out

    return groups


def spelled(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def texts_of(chance, n, marks=0.03):
    return ["".join(chance.choice(BITS + ["▁"] * (chance.random() < marks)) for _ in range(chance.randint(0, 25))) for _ in range(n)]


def test_words_are_aligned_as_whole_texts(chance, aligner, by_hand):
    texts = [t for t in texts_of(chance, 400) if t] + ["▁", "a▁b", "x  ", "word" * 300]
    cut = [token_alignment.words_of(t) for t in texts]
    got = token_alignment.add_words(cut, aligner.words({w for t in cut for w in t}), len(aligner.b_raw))
    start = 0
    for i, text in enumerate(texts):
        groups = by_hand(text)
        assert got.groups[i] == spelled(groups), text
        assert (got.n_a[i], got.n_b[i], got.n_groups[i]) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups))
        links = Counter(x << 32 | y for a, b in groups for x in a for y in b)
        pairs = dict(zip(got.pairs[start:got.ends[i]].tolist(), got.times[start:got.ends[i]].tolist()))
        assert pairs == links and got.n_links[i] == sum(links.values())
        start = got.ends[i]


def test_new_words_are_aligned_some_at_a_time(vocabularies, monkeypatch):
    """However many new words a slice has, and however many rows a batch, a bounded number is worked on at once."""
    aligner = token_alignment.Aligner(vocabularies.a_json, vocabularies.b_model)
    words, calls, aligned = {f"w{i}x{i * 7919 % 1000}" for i in range(20_000)} | {"▁", "a▁b"}, [], aligner._aligned
    monkeypatch.setattr(aligner, "_aligned", lambda some: calls.append(len(some)) or aligned(some))
    got = aligner.words(words)
    assert max(calls) <= 8_000 and set(got) == words  # halves of what does not come back from its bytes are calls too
    assert all(got[w] == aligned([w])[0] for w in sorted(words)[::500])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"one{i} two" for i in range(1000)]})
    monkeypatch.setattr(token_alignment.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    out = list(token_alignment._whole_texts(vocabularies)([batch]))
    assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= 250
    assert {x for b in out for x in b.column("block").to_pylist()} == {3 << 32}


@pytest.mark.parametrize("chunk", [1, 3, 7, 20])
def test_fragments_compose_in_any_tree(chance, aligner, by_hand, chunk):
    for text in filter(None, texts_of(chance, 150)):
        ranges = list(token_alignment.ranges_of(text, chunk))
        data = (" " + text).encode()
        assert "".join(r[2] for r in ranges).encode() == data and b"".join([b" " + r[4].encode() for r in ranges if r[4]]) == data
        found = [token_alignment.range_fragment(aligner, *r[1:]) for r in ranges]
        groups = by_hand(text)
        if not all(f[3] for f in found):
            assert not groups
            continue
        parts = [f[0] for f in found]
        while len(parts) > 1:
            at = chance.randrange(len(parts) - 1)
            parts[at:at + 2] = [token_alignment.compose(*parts[at:at + 2])]
        whole = token_alignment.finish(parts[0])
        assert ";".join(whole.groups) == spelled(groups), text
        assert whole.links == Counter(x << 32 | y for a, b in groups for x in a for y in b)
        assert (whole.n_groups, whole.n_links) == (len(groups), sum(whole.links.values()))


def test_composition_is_associative():
    chance = random.Random(2)
    for _ in range(300):
        ends = [sorted(chance.sample(range(1, 30), chance.randint(0, 12))) for _ in "ab"]
        cuts = [sorted(chance.sample(range(31), 2)) for _ in "ab"]
        parts = []
        for i in range(3):
            a, b = ([(e, e) for e in side if (cut[i - 1] if i else 0) < e <= (cut[i] if i < 2 else 30)] for side, cut in zip(ends, cuts))
            parts.append(token_alignment.fragment(a, b))
        x, y, z = parts
        left = token_alignment.compose(token_alignment.compose(x, y), z)
        right = token_alignment.compose(x, token_alignment.compose(y, z))
        whole = token_alignment.fragment(*[[(e, e) for e in side] for side in ends])
        for got in (left, right):
            assert (got.head, got.tail, got.cut, ";".join(got.groups), got.links) == (whole.head, whole.tail, whole.cut, ";".join(whole.groups), whole.links)


def expected(rows, by_hand):
    """Per row n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    all_groups = [by_hand(t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in all_groups]
    docs, most = Counter(), defaultdict(int)
    for found in links:
        docs.update(found.keys())
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [
        (doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
         sum(n for p, n in found.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in found.items()),
         hashlib.sha256(spelled(g).encode()).hexdigest() if g else "")
        for (doc, _), g, found in zip(rows, all_groups, links)
    ]


ROWS = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "the cat  sat\n on the mat"), (5, "the cat  sat\n on the mat"), (None, "The cat."),
        (6, "lorem  ipsum dolor\u00a0sit <|endoftext|> " * 60), (7, "nospaces" * 200), (8, "▁" + "x y  z " * 300)]


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_documents(documents, vocabularies, by_hand, chunk):
    aligned = token_alignment.align(documents(ROWS).repartition(3), vocabularies, chunk)
    held = token_alignment.stored(aligned)
    assert {r.groups for r in held.collect()} == {spelled(by_hand(t)) for _, t in ROWS}
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in token_alignment.with_counts(held).collect()]
    assert sorted(got, key=repr) == sorted((r[:-1] for r in expected(ROWS, by_hand)), key=repr)


def test_empty_tables(documents, vocabularies):
    for rows in ([], [(1, None)]):
        held = token_alignment.stored(token_alignment.align(documents(rows), vocabularies))
        assert [tuple(r) for r in token_alignment.with_counts(held).drop("groups").collect()] == [(1, 0, 0, 0, 0, 0, 0)] * len(rows)


def test_query_against_brute_force(spark, by_hand):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = queries.op12_token_alignment(spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows, by_hand), key=repr)
