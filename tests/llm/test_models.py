"""Language identification, toxicity, SentencePiece and the pipeline."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, strip_white
from tests.llm.test_mixing import targets_by_hand
from tests.llm.test_near_copies import check_kept
from tidewatch.llm import langid, sentencepieces, toxicity

# --- languages -------------------------------------------------------------------------------


def trigram_counts(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f"\0{word}\0"
        out.update(tuple(map(ord, padded[i:i + 3])) for i in range(len(padded) - 2))
    return out


def test_bundles_are_sums_of_bound_vectors():
    texts = ["Hello, wörld! hello", "", "1 2 3", "ñ", "a  b\n\nc", "日本語 x"]
    got = langid.bundles(texts, 128)
    for text, row in zip(texts, got):
        want = np.zeros(128)
        for gram, n in trigram_counts(text).items():
            a, b, c = langid.letter_vectors(np.array(gram), 128)
            want += n * np.roll(a, 2) * np.roll(b, 1) * c
        assert (row == want).all()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    known = docs.where(~langid.held_out(docs["doc_id"]))
    model = langid.learn(known)
    again = langid.learn(known.repartition(3))
    assert all((model[k] == again[k]).all() for k in model)
    got = langid.identify(docs.where(langid.held_out(docs["doc_id"])), model).join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(documents):
    rows = [(1, "the cat sat on the mat", "en", None), (2, "der hund und die katze", "de", None), (3, None, "en", None), (4, "12 !", "de", None),
            (None, "the cat", None, None), (5, "the mat " * 30_000, "en", None), (5, "the mat", "en", None)]
    frame = documents(rows)
    model = langid.learn(frame)
    assert sorted(model) == ["de", "en"]
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(frame, model).collect()), key=repr)
    assert got == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (5, "en"), (5, "en")], key=repr)
    kept = langid.accepted(frame, model)
    assert kept.columns == frame.columns and kept.count() == 5
    assert langid.learn(documents([])) == {}
    assert {r.lang_pred for r in langid.identify(frame, {}).collect()} == {"und"}
    assert langid.identify(documents([]), model).count() == 0


# --- toxicity --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lexicon():
    words = ["idiot", "idiots", "little", "letter", "title", "moron", "loser", "class", "bottle", "better", "boot", "ship", "dine"] * 20
    counts = Counter(f"^^{w}$"[i:i + 3] for w in words for i in range(len(w) + 1))
    features = {"=idiot": 5.0, "idio": 4.0, "=moron": 5.0, "=loser": 5.0}
    return toxicity.Model(features, dict(counts), 1.0, -3.0).prepare()


@pytest.mark.parametrize("seen", ["1d10t", "idiooot", "iiidiot", "i.d.i.o.t", "i-d-i-o-t", "1d1000t", "!d!ot"])
def test_hidden_words_are_read(lexicon, seen):
    assert toxicity.read_token(seen, lexicon) == "idiot"


def test_reading_is_the_best_of_all(lexicon):
    """Against all paths through a small lattice."""
    def paths(token):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(token)]
        choices = []
        for c, n in runs:
            out = [(x * t, p + (toxicity.COLLAPSE if t < n else 0)) for x, p in
                   ([(c, 0.0)] if c.isalpha() else []) + [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(c, "")]
                   for t in {1, min(n, 2)}]
            if not c.isalpha():
                out.append(("", toxicity.SKIP * (4 if c in toxicity.LEET and c.isdigit() else 1)))
            choices.append(out)
        for path in itertools.product(*choices):
            said, cost = "".join(s for s, _ in path), sum(p for _, p in path)
            padded = f"^^{said}$"
            yield cost - sum(lexicon.log_p(padded[i:i + 2], padded[i + 2]) for i in range(len(said) + 1)), said

    for token in ["1d1o7", "b00ttle", "tit1e", "cla$$", "m0r.on", "xx9"]:
        best = min(paths(token))
        got = toxicity.read_token(token, lexicon)
        assert min(c for c, s in paths(token) if s == got) == pytest.approx(best[0])


def test_spaced_and_hidden_words_count(lexicon):
    for text in ["you i d i o t", "you 1d10t!", "an IDIOT.", "such idiooots" * 1, "x " * 50_000 + "idiot"]:
        assert toxicity.total_evidence(text, lexicon) >= 4, text
    for text in ["", "a letter and a bottle", "1 2 3", "a a a a a a", "z" * 100_000]:
        assert toxicity.total_evidence(text, lexicon) == 0, text


@pytest.mark.parametrize("text", [
    "an !diot", "(an |oser)", "you are a m o r o n", "m o r o n l o s e r", "i\td\ti\to\tt", "m\no\nr\no\nn",
    "so m,  o,  r,  o,  n", "m" + "-" * 90 + "o.r.o.n", "m " + "r " * 200 + "  i d i o t", ("a." * 40)[:-1] + " 1" + "." * 80 + "diot"])
def test_marks_at_ends_spacing_and_long_tokens_are_read(lexicon, text):
    assert toxicity.total_evidence(text, lexicon) >= 4, text


def test_long_lattices_are_read_in_pieces(lexicon, monkeypatch):
    token = "1d10t m0r.on b00ttle tit1e cla$$ " * 20
    got = toxicity.read_token(token, lexicon)
    monkeypatch.setattr(toxicity, "_AGREE", 10**9)
    assert got == toxicity.read_token(token, lexicon) and len(got) > 400
    assert toxicity.total_evidence("idiot idiot! (idiot", lexicon) == 5


def test_short_tokens_and_doubled_letters_are_read():
    counts = Counter(f"^^{w}$"[i:i + 3] for w in ["ass", "die", "idiot", "das", "dot", "glass", "better", "letter"] * 50 for i in range(len(w) + 1))
    model = toxicity.Model({"=ass": 5.0, "=die": 5.0, "=idiot": 5.0, "idio": 4.0}, dict(counts), 1.0, -3.0).prepare()
    for text in ["ass", "a$$", "@ss", "die", "d!e", "d1e", "(d!e)", "iddiott", "iiddiioott", "iddi0t"]:
        assert toxicity.total_evidence(text, model) >= 4, text
    for text in ["glass", "better", "letter", "as", "dot", "$", "1", "a1"]:
        assert toxicity.total_evidence(text, model) == 0, text


def test_tokens_that_are_not_read_have_no_evidence(lexicon, chance):
    """The shortcut against reading every token, with features of letters, doubled letters and signs."""
    more = {"=1d10t": 3.0, "los$": 3.0, "=mm": 2.0, "sse": 1.0}
    lexicon = toxicity.Model(lexicon.features | more, lexicon.trigrams, 1.0, -3.0).prepare()
    letters, marks = "idotmrnlsex", "10!@$-.3"
    tokens = {"".join(chance.choice(letters + (marks if chance.random() < 0.5 else letters)) for _ in range(chance.randint(1, 9))) for _ in range(3000)}
    tokens |= {w[:k] + c * chance.randint(1, 3) + w[k:] for w in ("idiot", "moron", "loser", "1d1ot", "1d10t", "m0ron", "los$er", "mm") for k in range(6) for c in letters + marks}
    for token in tokens:
        words = {core} if (core := token.strip(toxicity.PUNCTUATION)) else set()
        words |= {toxicity.read_token(f, lexicon) for f in {core, token.strip(toxicity.MARKS)} if toxicity.suspicious(f)}
        want = max((lexicon.features.get(f, 0.0) for w in words for f in toxicity.features_of(w)), default=0.0)
        assert toxicity.evidence(token, lexicon) == want, token


def test_all_strong_features_are_kept(spark, documents):
    """As many as there are, with the statistic of the driver's own formula."""
    rows = [(i, " ".join([f"bad{i % 40}x", f"common{i % 7}"] if i % 2 else [f"good{i % 40}x", f"common{i % 7}"])) for i in range(4000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.learn(documents(rows), labels)
    assert {f"=bad{i}x" for i in range(1, 40, 2)} <= set(model.features) and not any("good" in f or "common" in f for f in model.features)
    frame = spark.createDataFrame([(9, 1), (3, 0), (100, 90), (40, 2)], "a long, b long")
    got = [r.g for r in frame.select(toxicity.gain(F.col("a"), F.col("b"), 300, 500).alias("g")).collect()]
    for (a, b), g in zip([(9, 1), (3, 0), (100, 90), (40, 2)], got):
        p = 300 / 800
        assert g == pytest.approx(2 * (a * np.log(a / ((a + b) * p)) + (b * np.log(b / ((a + b) * (1 - p))) if b else 0)))


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(labels["doc_id"])))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    caught = [r.score >= toxicity.CUT for r in rows if r.toxic == 1]
    wrong = [r.score >= toxicity.CUT for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.6 and np.mean(wrong) < 0.03


def test_language_model_counts_all_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    rows = [(i, "bad word" if i % 2 else "fine word") for i in range(400)] + [(1000 + i, "žluť") for i in range(7)] + [(None, "žluť")]
    got = toxicity.learn(documents(rows), labels, sample=5).trigrams
    assert got["wor"] == 400 and got["bad"] == 200 and got["^^f"] == 200 and got["žlu"] == 8


def test_toxicity_edge_cases(spark, documents):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(documents([(1, "bad"), (2, None)]), labels)
    got = toxicity.score(documents([(1, "bad"), (None, None), (2, ""), (2, "")]), model).collect()
    assert [r.score for r in got] == [0.5] * 4  # one label only
    both = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(documents([(1, None), (2, "fine")]), both)
    assert all(0 <= r.score <= 1 for r in toxicity.score(documents([(1, "x"), (3, None)]), model).collect())
    assert toxicity.score(documents([]), model).count() == 0


# --- SentencePiece ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.load()


TEXTS = ["", "a", " ", "  two  spaces ", "▁", "x▁y \0 \0m\0\0 0", "line\n\n next\ttab\r", "日本語 🎉 ñandú", "the " * 4000, "word" * 5000]


def test_round_trip(pieces):
    for text, ids in zip(TEXTS, sentencepieces.encode_texts(TEXTS, pieces)):
        assert sentencepieces.decode_ids(ids, pieces) == text


def test_ids_that_are_no_text(pieces):
    assert sentencepieces.decode_ids([-1, 10**6, 0, pieces.byte_ids[0xC3], pieces.byte_ids[0x41]], pieces) == "\ufffdA"
    assert sentencepieces.decode_ids([], pieces) == ""


def test_best_of_all_segmentations(pieces):
    def score(piece):
        node = pieces.trie
        for char in piece:
            node = node[0].get(char)
            if node is None:
                return None
        return node[2] if node[1] >= 0 else None

    def best(word):
        most = [0.0]
        for end in range(1, len(word) + 1):
            options = [(most[s] + score(word[s:end])) for s in range(end) if score(word[s:end]) is not None]
            most.append(max(options + ([most[end - 1] + pieces.unknown] if score(word[end - 1]) is None else [])))
        return most[-1]

    words = sorted({"▁the", "▁then", "▁thence", "▁other", "▁▁▁", "▁qwxz", "▁日本", "▁a", "▁antidisestablishment", "▁🎉x"})
    for word, packed in sentencepieces.encode_sorted(words, pieces):
        by_id, ids = {}, np.frombuffer(packed, np.int32).tolist()
        stack = [(pieces.trie, "")]
        total, text, i = 0.0, word, 0
        names = {i: None for i in ids}
        while stack:
            node, name = stack.pop()
            if node[1] in names:
                by_id[node[1]] = (name, node[2])
            stack += [(child, name + c) for c, child in node[0].items()]
        while i < len(ids):
            if ids[i] in by_id:
                name, value = by_id[ids[i]]
                total, text, i = total + value, text[len(name):], i + 1
            else:
                n = len(text[0].encode())
                total, text, i = total + pieces.unknown, text[1:], i + n
        assert text == "" and total == best(word)


def test_as_the_library_segments(pieces):
    """With the file's scores read as a unigram model; the library adds in single precision, so huge ones are shrunk."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = proto.ModelProto()
    model.ParseFromString(open(sentencepieces.MODEL_FILE, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -1e5)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["The cat sat on the mat, and then it left.", "Éeauné que de la", "thinst hand of wh heer", "x  y"]:
        assert sentencepieces.encode_texts([text], pieces)[0] == library.encode(text)


def test_documents_are_encoded_and_decoded(documents, pieces):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3])]
    encoded = sentencepieces.encode(documents(rows), pieces)
    got = sentencepieces.decode(encoded, pieces).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert sorted(sentencepieces.round_trip(documents(rows), pieces).collect(), key=repr) == sorted(got, key=repr)
    assert sentencepieces.decode(sentencepieces.encode(documents([]), pieces), pieces).count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_by_hand(spark):
    """Each stage on what its predecessor kept, against plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages, folder = dict(corpus_pipeline.STAGES), f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def shown(frame):
        return [(r.doc_id, r.text, r.source) for r in frame.select("doc_id", "text", "source").collect()]

    rows = [r for r in shown(docs) if any(c.isalpha() for c in r[1] or "")]
    accepted = stages["language_id"](spark, docs, folder)
    assert sorted(shown(accepted), key=repr) == sorted(rows, key=repr)
    best = {}
    for doc, text, source in rows:
        key = strip_white(text)
        best[key] = min(best.get(key, ((1, 0),)), ((-len(text), doc), text, source))
    exact = stages["exact_dedup"](spark, accepted, folder)
    rows = sorted((k[1], text, source) for k, text, source in best.values())
    assert sorted(shown(exact)) == rows
    near = stages["near_dedup"](spark, exact, folder)
    kept = sorted(shown(near))
    assert set(kept) < set(rows)
    check_kept([(n, t) for n, (_, t, _) in enumerate(rows)], {n for n, r in enumerate(rows) if r in set(kept)})
    sizes = Counter()
    for _, text, source in kept:
        sizes[source] += len(text.split())
    target = targets_by_hand(sizes)
    times = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect())
    assert set(times) <= {(d, t) for d, t, _ in kept}
    for doc, text, source in kept:
        rate = target[source] / sizes[source]
        assert int(rate) <= times[doc, text] <= int(rate) + 1


def test_pipeline_stages_on_an_empty_table(spark, documents):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents([]), "")
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents([]).columns
