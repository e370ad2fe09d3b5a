"""Near-duplicate groups against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, near_dedup, shingles


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(rows[x][0]), root(rows[y][0])))
                parent[q] = p
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(1, 150))
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    for _ in range(100):  # a shared passage, more or less of the whole
        rows.append(" ".join(passage + rng.choices(vocabulary, k=rng.choice([3, 8, 12, 30]))))
    base = rng.choices(vocabulary, k=120)
    for _ in range(150):  # a large group of near copies
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [" ".join(base)] * 30 + ["", None, " \t\n", "One", "one ", "one two", "ONE\ttwo", "É é", "é é"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_equals_all_pairs(spark, monkeypatch, seed, words, percent):
    monkeypatch.setattr(near_dedup, "LONG", 20)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in near_dedup.near_copies(docs, words, percent).collect())
    assert found == brute(rows, words, percent)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, node long, n long, sketch string, component long"
    assert near_dedup.near_copies(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f", 1, 1, "", 1), (7, "a b c d e f", 1, 1, "", 1), (7, "a b c d e f", 1, 1, "", 1), (3, None, 1, 1, "", 1)]
    found = sorted((tuple(r) for r in near_dedup.near_copies(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(None, 2, None, True), (7, 2, None, False), (7, 2, None, False), (3, 0, 3, True)], key=str)


def test_two_large_groups_that_share_a_passage(spark, monkeypatch):
    """Lists of many members in two components: keys and pairs are dealt out in parts, and no link is lost."""
    monkeypatch.setattr(near_dedup, "LONG", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=80)
    texts = []
    for _ in range(2):
        base = passage + rng.choices(vocabulary, k=40)
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(80, len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(passage + rng.choices(vocabulary, k=3)) for _ in range(10)]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    found = sorted(tuple(r) for r in near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert found == brute(rows, 5, 80)


@pytest.mark.parametrize("most", [1, 7, 64, 10_000])
def test_a_text_in_parts_has_the_set_of_the_whole(most):
    rng = random.Random(most)
    texts = ["", " ", "one", " one two\t", "x" * 500, "Été " * 40, " ".join(rng.choices("abcdeF", k=400)), "".join(rng.choices("ab \n", k=900))]
    for words in (1, 3, 5):
        for text, want in zip(texts, shingles.sets(pa.array(texts), words), strict=True):
            found = shingles.long_set(np.frombuffer(text.encode(), np.uint8), words, most)
            assert found.tolist() == want.tolist(), (text, words)


def test_texts_of_equal_parts_in_another_order_are_apart(spark):
    """Polynomials modulo a power of two cannot tell these two words apart, whatever their base."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, "x " + a + " y z"), (4, "x " + b + " y z")]
    found = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(i, i, True) for i in (1, 2, 3, 4)]
    blocks = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    orders = {"".join(p) for p in ((blocks[i], blocks[j], blocks[k]) for i in range(3) for j in range(3) for k in range(3))}
    assert len({s.tobytes() for s in shingles.sets(pa.array(sorted(orders)), 5)}) == len(orders)


def test_words_that_go_on_over_parts():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices("abcdefg A\n", weights=[8, 8, 8, 8, 8, 8, 8, rng.choice([1, 6, 30]), 2, 1], k=rng.randint(0, 200)))
        want = next(iter(shingles.sets(pa.array([text]), 2)))
        for most in (1, 7, 8, 16, 33, 64):
            assert shingles.long_set(np.frombuffer(text.encode(), np.uint8), 2, most).tolist() == want.tolist()
