"""Repeated spans against a dictionary of all windows."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import repeated_spans
from tessera.llm.common import SHUFFLE_SETTING


def brute(rows, depth):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - depth + 1):
            w = raw[i : i + depth]
            if w in seen:
                gone[i : i + depth] = [True] * depth
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "été", "x", "gamma", "日本", "delta", "the", "of"]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    passages = [prose(40) for _ in range(4)]
    texts = []
    for _ in range(80):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randint(60, 200)], prose(rng.randint(0, 20))]
        texts.append(" ".join(parts))
    texts += [texts[3]] * 4 + [texts[5].upper(), "a" * 350, "ab" * 200, "a" * 90, "a" * 100, "", None]
    texts += [passages[0] + str(i) for i in range(40)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True)) + [(None, texts[0])]


@pytest.mark.parametrize(("seed", "large", "local"), [(1, 2000, 128), (2, 6, 128), (3, 20, 10)])
def test_equals_a_dictionary_of_windows(spark, seed, large, local):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r) for r in repeated_spans.remove_repeats(docs, large=large, local=local).collect()), key=str)
    assert found == brute(rows, repeated_spans.DEPTH)


def test_repeated_rows_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, node long, pos int, copy boolean, marks string"
    assert repeated_spans.remove_repeats(spark.createDataFrame([], schema)).collect() == []
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(1, text, 0, 0, True, ""), (1, text, 0, 0, True, ""), (2, text[50:], 0, 0, True, ""), (2, "short", 0, 0, True, "")]
    found = {(r.doc_id, r.n_bytes, r.n_removed) for r in repeated_spans.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert (1, 300, 0) in found and (2, 5, 0) in found and len(found) == 3


def test_every_text_of_a_null_or_repeated_id_is_searched(spark):
    rng = random.Random(8)
    a, b, c, d = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(4))
    rows = [(None, a), (None, b), (None, "x" + a[20:250]), (1, c), (1, d), (1, c[:150] + d[:150]), (2, b[30:200]), (3, "y" + d[100:] + a[:120]), (4, "z")]
    found = sorted((tuple(r) for r in repeated_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    assert found == brute(rows, repeated_spans.DEPTH)


@pytest.mark.parametrize("seed", range(4))
def test_radix_order_is_the_order_of_the_bytes(seed):
    rng = np.random.default_rng(seed)
    for width in (1, 8, 13, 100):
        block = rng.integers(0, 2, (60, width), dtype=np.uint8) * rng.integers(1, 255, dtype=np.uint8)
        block[20:40, : width * 3 // 4] = block[20, : width * 3 // 4]
        group = np.sort(rng.integers(0, 5, 60))
        order, shared = repeated_spans.radix_order(group, repeated_spans.digits(block))
        rows = [(group[i], block[i].tobytes()) for i in order]
        assert rows == sorted((g, b.tobytes()) for g, b in zip(group, block, strict=True))
        for i in range(1, 60):
            (g, x), (h, y) = rows[i - 1], rows[i]
            same = next((k for k, (a, b) in enumerate(zip(x, y, strict=True)) if a != b), width)
            assert min(shared[i], width) == (same if g == h else 0)


@pytest.mark.parametrize("seed", range(6))
def test_later_windows_equal_a_dictionary(seed):
    """Groups of one, two and many rows, with copies, zero bytes and text ends near the anchor."""
    rng = np.random.default_rng(seed)
    depth, left = 40, 8
    context = np.where(rng.random((120, left + depth)) < 0.04, rng.integers(0, 3, (120, left + depth)), 1).astype(np.uint8)
    context[60:90] = context[rng.integers(0, 60, 30)]
    group = np.sort(rng.integers(0, 40, 120))
    order = np.arange(120)
    before, after = np.where(rng.random(120) < 0.2, rng.integers(0, left, 120), left), np.where(rng.random(120) < 0.2, rng.integers(32, depth, 120), depth)
    for i in range(120):
        context[i, : left - before[i]] = 0
        context[i, left + after[i] :] = 0
    found = repeated_spans.later_windows(group, order, before, after, context, depth)
    seen, want = set(), np.zeros_like(found)
    for i in range(120):
        for c in range(left + 1):
            if c >= left - before[i] and c + depth <= left + after[i]:
                key = (group[i], c, context[i, c : c + depth].tobytes())
                want[i, c] = key in seen
                seen.add(key)
    assert (found == want).all()


def test_parts_of_a_long_text_have_its_anchors():
    from tessera.llm.shingles import Powers

    data = np.random.default_rng(3).integers(97, 100, 30_000).astype(np.uint8)
    whole = repeated_spans.anchors(data, np.array([0, len(data)]), 100, Powers())
    parts = list(repeated_spans.text_anchors(data, 100, Powers(), most=1000))
    assert (np.concatenate([p[0] for p in parts]) == whole[0]).all()
    assert (np.concatenate([p[1] for p in parts]) == whole[1]).all()


def _shuffles(spark):
    """The numbers of the shuffles that have files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    """Of all that was shuffled only what the caller's own query reads stays while the driver collects no garbage."""
    kept = spark.conf.get(SHUFFLE_SETTING, None)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words of a text "), 9).alias("text"))
    before = _shuffles(spark)
    result = repeated_spans.remove_repeats(docs)
    for _ in range(50):  # files go in the background
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert spark.conf.get(SHUFFLE_SETTING, None) == kept
    assert result.where("n_removed = n_bytes").count() == 199
