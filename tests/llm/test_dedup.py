"""Line, exact and repeated-string de-duplication against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import strip_white
from tidewatch.llm import exact_dedup, line_dedup, suffix_dedup

LONG = "a line with more than twenty characters"


def lines_by_hand(rows, min_chars=20, min_docs=3):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(upper)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines, keep = (text or "").split("\n"), []
        for line in lines:
            ids = holders[key(line)] - {None}
            gone = len(key(line)) >= min_chars and len(ids) >= min_docs and (doc is None or doc < max(ids))
            keep += [] if gone else [line]
        out.append((doc, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_lines_match_brute_force(documents, chance):
    pool = [LONG, LONG.upper(), f"\t {LONG} \r", "É" + LONG, "é" + LONG, "short", "", "y" * 19, "z" * 20, "Z" * 20 + "\x0b"]
    rows = [(i, "\n".join(chance.choice(pool) for _ in range(chance.randint(0, 6)))) for i in range(40)]
    rows += [(None, LONG), (None, None), (41, None), (42, ""), (3, LONG), (3, LONG), (50, "\n".join([LONG] * 3000))]
    got = line_dedup.dedup_lines(documents(rows)).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert ordered(map(tuple, got)) == ordered(lines_by_hand(rows))


def test_a_line_in_two_documents_stays_and_empty_tables_work(documents):
    rows = [(1, LONG), (2, LONG), (2, LONG)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(documents(rows)).collect()} == {0}
    assert line_dedup.dedup_lines(documents([])).count() == 0


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[strip_white(text)].append((-len(text or ""), doc is None, doc))
    out = []
    for doc, text in rows:
        group = groups[strip_white(text)]
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0))
        out.append((doc, best[2], len(group), hashlib.sha256(strip_white(text).encode()).hexdigest()))
    return out


def test_exact_groups_match_brute_force(documents, chance):
    stem = "".join(chance.choice("abcdé") for _ in range(20_000))
    cuts = [0, 1, 63, 64, 65, 1087, 1088, 1089, 17_471, 17_472, 17_473, 20_000]
    rows = [(i, stem[:n]) for i, n in enumerate(cuts * 2)]
    rows += [(100 + i, stem[:n] + t) for i, (n, t) in enumerate([(64, "x"), (1088, "x"), (1088, "y"), (20_000, " \n")])]
    rows += [(200, None), (201, " \t"), (None, stem[:64]), (7, stem[:64]), (7, stem[:64]), (300, "one of its own")]
    rows += [(400 + i, "copies " * 3) for i in range(50)]
    got = exact_dedup.assign(documents(rows))
    found = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()]
    assert ordered(found) == ordered(exact_by_hand(rows))
    kept = got.where("kept")
    assert kept.count() == len({strip_white(t) for _, t in rows})
    left = exact_dedup.dedup(documents(rows))
    assert left.columns == documents([]).columns
    assert sorted(strip_white(r.text) for r in left.collect()) == sorted({strip_white(t) for _, t in rows})


def test_exact_empty_table(documents):
    assert exact_dedup.assign(documents([])).count() == 0
    assert exact_dedup.dedup(documents([])).count() == 0


def with_repeats(chance, n=60):
    word = lambda: "".join(chance.choice("abcdefghé") for _ in range(chance.randint(1, 9)))
    passages = [" ".join(word() for _ in range(k)) for k in (8, 9, 10, 11, 12, 20, 40, 200)] + ["ab" * 60, "z" * 130]
    rows = []
    for i in range(n):
        parts = [chance.choice(passages) if chance.random() < 0.4 else " ".join(word() for _ in range(8)) for _ in range(5)]
        rows.append((i, " ".join(parts)))
    return rows


def test_repeats_match_brute_force(documents, chance):
    rows = with_repeats(chance)
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "q" * 50), (104, "q" * 50), (9, rows[3][1]), (9, rows[3][1]), (None, rows[3][1])]
    got = suffix_dedup.remove_repeats(documents(rows)).withColumn("sha", F.sha2("kept", 256)).drop("kept").collect()
    known = [(i, (t or "").encode()) for i, t in rows if i is not None]
    want = suffix_dedup.brute_force(known)
    alone = rows[3][1].encode()
    want.append((None, len(alone), 0, 0, hashlib.sha256(alone).hexdigest()))
    assert ordered(map(tuple, got)) == ordered(want)
    assert sum(w[2] for w in want) > 1000


def test_repeats_of_an_empty_table(documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_anchors_do_not_depend_on_the_pieces(chance, monkeypatch):
    texts = [t.encode() for _, t in with_repeats(chance, 20)]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    buffer = suffix_dedup.Buffer(data, sizes[:-1], sizes[1:])
    whole = suffix_dedup.anchors(buffer, 50, 20)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 97)
    for a, b in zip(whole, suffix_dedup.anchors(buffer, 50, 20)):
        assert (a == b).all()
    # Every window holds an anchor, and equal windows hold the same one.
    place = {}
    for owner, start, at in buffer.window_anchors(50, 20):
        for s, a in zip(start, at):
            assert s <= a <= s + 30
            assert place.setdefault(bytes(data[s:s + 50]), a - s) == a - s


def test_long_groups_come_in_parts(monkeypatch):
    import pyarrow as pa

    key = np.repeat([1, 2], [600_000, 3])
    row = np.concatenate([np.arange(600_000), [5, 5, 5]])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:i + 9000]), pa.array(row[i:i + 9000]), pa.array(np.ones(len(key[i:i + 9000]), np.int64))],
                                          ["key", "row_key", "pos"]) for i in range(0, len(key), 9000)]
    assert sum(b.num_rows for b in suffix_dedup._keep_shared(iter(batches))) == 600_000


def test_windows_hold_what_their_quarter_shares():
    for window, gram in [(50, 20), (50, 26), (20, 8), (12, 8), (9, 8)]:
        parts = suffix_dedup.quarters(window, gram)
        step = parts[1][0] if len(parts) > 1 else window
        assert len(parts) <= 4
        for begins in range(window - gram + 1):  # bytes between a window's start and its anchor
            before, after = parts[begins // step]
            assert before <= begins and after <= window - begins


@pytest.mark.parametrize("later", [[7], [5] * 700_000 + [7], [7] * 700_000, [5] * 700_000])
def test_long_groups_are_judged_as_a_whole(later):
    rows = np.array([3, 9] + [5] * 1_200_000 + later + [4, 8, 8])
    keys = np.array([0, 0] + [1] * (1_200_000 + len(later)) + [2, 3, 3])
    places = np.arange(len(rows))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[at:at + 10_000]) for c in (keys, rows, places)], ["key", "row_key", "pos"])
               for at in range(0, len(rows), 10_000)]
    got = pa.Table.from_batches(list(suffix_dedup._keep_shared(iter(batches)))).to_pydict()
    want = (keys == 0) | ((keys == 1) & (7 in later))
    assert sorted(got["pos"]) == places[want].tolist() and set(zip(got["pos"], got["row_key"])) == set(zip(places[want], rows[want]))
