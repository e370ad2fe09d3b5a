"""Hard negatives against brute force, and the bounds against the scores."""

import math

import numpy as np
import pytest

from tessera.llm import hard_negatives as hn


def plain(rows, positives=5, negatives=3):
    """The answer by comparing every anchor with every row, in Python's integers."""
    sound = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is None, r[1], r[2] or [])):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a, (label, x) in sound.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in sound.items() if i != a and len(y) == len(x))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            kept = [s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:negatives]
            out |= {(a, p, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(kept, 1)}
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as id", "2 as angles", "3 as `a.b`").repartition(3)
    got = [tuple(r) for r in hn.mine(table, lambda i: i % 50 == 0, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def spread(n, dim, seed, labels=4):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, dim))
    return [(i, int(random.integers(labels)), (0.3 * random.normal(size=dim) + centres[random.integers(6)]).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dim", "references"), [(3, 4), (16, 16), (2, 1)])
def test_equals_brute_force(spark, dim, references):
    rows = spread(700, dim, dim)
    assert found(spark, rows, references=references, block=5, stripe=100) == plain(rows)


def test_ties_copies_nulls_repeats_and_odd_vectors(spark):
    rows = spread(120, 4, 9)
    rows += [(200 + i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]  # one vector very often
    rows += [(1000, 1, [0.0] * 4), (1001, None, [1.0] * 4), (None, 1, [1.0] * 4), (1002, 1, None), (1003, 1, [1.0, None, 1.0, 1.0]), (1004, 1, [math.nan] * 4)]
    rows += [(1050, 1, [math.inf] * 4), (1100, 2, [1.0, 2.0]), (1101, 2, [1.0, 1.5]), (1102, 3, [0.7, 0.8]), (1150, 1, []), (1151, 2, [])]
    rows += [(1200, 1, [0.1] * 4), (1200, 0, [0.2] * 4), (1200, 0, [0.2] * 4)]
    got = found(spark, rows)
    assert got == plain(rows) and len({r[0] for r in got}) > 3


def test_scores_beyond_doubles_are_exact(spark):
    random = np.random.default_rng(3)
    rows = [(i, int(i % 3), (1e5 * random.normal(size=3) + 2e5).astype(np.float32).tolist()) for i in range(120)]
    assert found(spark, rows) == plain(rows)
    far = [(50 * i, i % 2, [1e9, 1e9]) for i in range(4)]
    assert found(spark, far) == set()


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, [(50, 1, [1.0])]) == set()


def test_no_score_leaves_its_bounds_and_most_are_filtered_where_references_are_near():
    random = np.random.default_rng(5)
    centres = random.normal(size=(8, 8)) * 256
    x = np.floor(centres[random.integers(8, size=600)] + 5 * random.normal(size=(600, 8)))
    norm, angles = np.linalg.norm(x, axis=1), hn.angles(x, hn.spread_out(x, 8))
    least, most = hn.bounds(angles, angles, norm, norm)
    score = x @ x.T
    assert (least <= score).all() and (score <= most).all()
    top = np.sort(score, axis=1)[:, -6]
    assert (most >= top[:, None]).mean() < 0.3
