"""Unigram encoding, decoding and counting against plain searches and the tokenizer library itself."""

import random

import numpy as np
import pytest

from tessera.llm import sentencepiece_codec as codec
from tessera.llm import token_counts, unigram
from tessera.llm.unigram import SPACE, STEPS, Decoder, Units, Vocabulary, as_unigram, marked, trace

NONE = float("-inf")


@pytest.fixture(scope="module")
def v():
    return Vocabulary.load(codec.VOCABULARY)


def whole_search(text, v):
    """One search over the whole text, without units or chunks."""
    searched = marked(text)
    n = len(searched)
    best, back = [0.0] + [NONE] * n, [-1] * (n + 1)
    for s in range(n):
        single = False
        for e in range(s + 1, min(n, s + v.longest) + 1):
            found = v.pieces.get(searched[s:e])
            if found and best[s] + found[1] > best[e]:
                best[e], back[e] = best[s] + found[1], s
            single = single or (found is not None and e == s + 1)
        if not single and best[s] + v.unknown_score > best[s + 1]:
            best[s + 1], back[s + 1] = best[s] + v.unknown_score, s
    return trace(searched, back, n, v)[1]


TEXTS = [
    "", " ", "a", "  a", "Hello wörld  the eauouon", "x\ny\tz", "日本語 😀 test", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 5,
    "the" * 90, "a▁b ▁c", "    spaces     here", "Ñ ciónraie. Jaco ñarga de que",
]


def test_units_and_counts_equal_one_search_over_the_whole(v):
    units, counter = Units(v), token_counts.Counter(v)
    for t in TEXTS:
        ids = units.encode(marked(t))
        assert ids == whole_search(t, v)
        assert counter.count(t) == len(ids)
        assert Decoder(v).decode(ids) == t.replace(SPACE, " ")


def test_ids_equal_the_library(v):
    """Text by text, ties included: whole documents of four languages and strings of awkward characters."""
    import pyarrow.parquet as pq
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(codec.VOCABULARY).SerializeToString())
    rng = random.Random(3)
    parts = ["a", "b", " ", "the", "ing", "▁", "\n", "é", "日", "😀", "\t", "tion", "e", "<s>", "<0x41>", "\u0301", "xxxxx", "oo", "▁▁", "  "]
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += TEXTS + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(2000)]
    units, counter = Units(v), token_counts.Counter(v)
    for t in texts:
        ids = library.encode(t)
        assert units.encode(marked(t)) == ids
        assert counter.count(t) == len(ids)


@pytest.fixture(scope="module")
def real(tmp_path_factory):
    """A unigram model whose log-probabilities are no steps of anything."""
    model = as_unigram(codec.VOCABULARY)
    rng = random.Random(11)
    for p in model.pieces:
        if p.type == 1:
            p.score = p.score * rng.uniform(0.9, 1.1) - rng.random()
    path = str(tmp_path_factory.mktemp("model") / "real.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path


def test_ids_by_the_scores_of_a_unigram_file_equal_the_library(real):
    import pyarrow.parquet as pq
    import sentencepiece

    library, v = sentencepiece.SentencePieceProcessor(model_file=real), Vocabulary.load(real)
    units, counter = Units(v), token_counts.Counter(v)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()][:300]
    same = 0
    for t in texts:
        ids, want = units.encode(marked(t)), library.encode(t)
        assert counter.count(t) == len(ids)
        same += ids == want
        if ids != want:  # within what single precision may round
            score = lambda found: sum(library.get_score(i) for i in found)
            assert 0 <= score(ids) - score(want) < 1e-6 * len(t) * len(ids)
    assert same >= 295


def test_files_that_are_not_known_are_refused(real, tmp_path):
    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[500], "type", 4)):
        model = as_unigram(real)
        change(model)
        (tmp_path / "odd.model").write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            Vocabulary.load(str(tmp_path / "odd.model"))


def test_parts_and_windows_count_as_one_search(v, monkeypatch):
    rng = random.Random(4)
    texts = [*TEXTS, "".join(rng.choices(["the", "ab", "é", " ", "😀", "\n"], k=3000)), "".join(rng.choices("thein", k=5000))]
    want = [token_counts.Counter(v).count(t) for t in texts]
    for part in (1, 7, 300):
        monkeypatch.setattr(token_counts, "PART", part)
        counter = token_counts.Counter(v)
        assert [counter.count(t) for t in texts] == want


def test_steps_and_law(v):
    scores = [s for _, s in sorted(v.pieces.values())]
    assert scores == sorted(scores, reverse=True) and all(s * STEPS == round(s * STEPS) for s in scores)
    assert sum(np.exp(scores)) == pytest.approx(1, abs=0.05)


def test_chunks_equal_one_search(spark, v):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        alphabet = rng.choice(["ab", "the ", "aeiounrst  ", "a▁ b", "日本x "])
        rows.append((i, "".join(rng.choices(alphabet, k=rng.randint(60, 700)))))
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, rows[8][1]), (102, "a" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id or -1, r.ids) for r in codec.encode(docs, chunk=64).collect()))
    assert found == sorted((i or -1, whole_search(t or "", v)) for i, t in rows)
    assert all(r.decoded for r in codec.round_trip(docs, chunk=64).collect())


def test_a_giant_text_without_spaces(spark, v):
    """A million characters in 31 chunks, one block of the scan each way."""
    rng = random.Random(6)
    text = "".join(rng.choices(["the", "ab", "é", "x", "日"], k=400_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert codec.encode(docs).first().ids == Units(v).encode(marked(text))
    assert token_counts.count_tokens(docs).first().n_tokens == codec.encode(docs).select("ids").first().ids.__len__()


def test_combine_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-9, 9, (5, 5)).astype(float) for _ in range(3))
    assert (codec.combine(codec.combine(a, b), c) == codec.combine(a, codec.combine(b, c))).all()


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string, row int, chunk int")
    assert codec.encode(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id long, text string, ids string, row int, chunk int")
    assert [r.doc_id for r in codec.round_trip(docs).collect()] == [1]
    assert token_counts.count_tokens(docs).first().n_chars == 3


@pytest.mark.parametrize("alphabet", ["abcdeinorst", "aeéß日本\U0001f600q▁<0x>\t\n"])
def test_units_side_by_side_equal_units_alone(alphabet, monkeypatch):
    """Ids and scores of many new units, without a search of its own for each that the pieces can spell."""
    rng = random.Random(11)
    units = Units(Vocabulary.load(codec.VOCABULARY))
    words = list({"".join(rng.choices(alphabet, k=rng.randint(1, unigram.CACHED_CHARS + 2))) for _ in range(1500)} | {"a" * n for n in range(1, 70)})
    alone, calls = units._search, []
    monkeypatch.setattr(units, "_search", lambda unit: calls.append(unit) or alone(unit))
    want = [alone(w) for w in words]
    found = units.spelled([[w] for w in words])
    assert [tuple(np.frombuffer(f, "<i4").tolist()) for f in found] == [ids for ids, _ in want]
    assert all(len(w) > unigram.CACHED_CHARS or any(c not in units.v.pieces for c in w) for w in calls)
    assert len(calls) < len(words)
    assert units.score(words) == sum(score for _, score in want)
    assert all(len(w) <= unigram.CACHED_CHARS for held in (units.known, units.scores) for w in held)


def test_a_full_cache_is_emptied_and_texts_stay_whole(monkeypatch):
    monkeypatch.setattr(unigram, "CACHED_UNITS", 200)
    monkeypatch.setattr(unigram, "GROUP_CHARS", 300)
    rng = random.Random(12)
    texts = [marked(" ".join("".join(rng.choices("aeinrst", k=rng.randint(1, 7))) for _ in range(rng.randint(0, 90)))) for _ in range(60)]
    units = Units(Vocabulary.load(codec.VOCABULARY))
    found = [np.frombuffer(f, "<i4").tolist() for f in units.encode_all(texts)]
    assert found == [[i for u in units.cut(t) for i in units._search(u)[0]] for t in texts]
    assert len(units.known) <= 200 + 300
