"""The Merkle manifest against plain loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def levels_of(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        found += level[at ^ 1 : (at ^ 1) + 1]
        at >>= 1
    return found


def expected(rows):
    """(id, leaf) to (subroot, siblings), and the root."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([leaf(r) for r in groups[g]]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    found = []
    for g in names:
        for i, r in enumerate(groups[g]):
            found.append((r["doc_id"], leaf(r), trees[g][-1][0], "".join(siblings(trees[g], i) + siblings(top, names.index(g)))))
    return found, top[-1][0]


def key(row):
    return tuple((x is not None, x or 0) for x in row[:1]) + tuple(row[1:])


def rows_of(spark, sizes):
    made = [(1000 * k + i, f"text {i} é" if i % 5 else None, lang, None if i % 3 else "s", i) for k, (lang, n) in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("sizes", [
    [("en", 1)], [("en", 2)], [("en", 35)], [("en", 1), ("de", 1)], [("en", 17), (None, 5), ("", 1), ("é", 3), ("z", 16)], [(f"l{i}", 1 + i % 3) for i in range(21)],
])
def test_trees_and_proofs(spark, sizes):
    docs = rows_of(spark, sizes)
    want, root = expected([r.asDict() for r in docs.collect()])
    for levels in (1, 4):
        built = merkle.build(docs, FIELDS, levels=levels)
        assert built.root == root
        got = [(r.id, bytes(r.leaf).hex(), r.subroot, bytes(r.siblings).hex()) for r in merkle.prove(built).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert {bytes(r.folded).hex() for r in merkle.prove(built).collect()} == {root}


def test_tampered_rows_do_not_fold_to_the_root(spark):
    docs = rows_of(spark, [("en", 40), ("de", 7)])
    built = merkle.build(docs, FIELDS, keep={"claimed": F.when(F.col("doc_id") % 7 == 0, merkle.leaf_digest([F.lit("other")]))})
    found = {r.id: bytes(r.folded).hex() == built.root for r in merkle.prove(built, F.coalesce("claimed", "digest")).collect()}
    assert len(found) == 47 and all(ok == (i % 7 != 0) for i, ok in found.items())


def test_copies_of_high_rows_for_blocks_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = rows_of(spark, [("en", 300), ("de", 20), ("fr", 1)])
    want, root = expected([r.asDict() for r in docs.collect()])
    built = merkle.build(docs, FIELDS, levels=2)
    most = built.rows.where("at_tree >= 0").groupBy("at_tree", "at_row", "at_index").count().agg(F.max("count")).first()[0]
    assert most == 38  # the row above all 300 leaves
    got = [(r.id, bytes(r.leaf).hex(), r.subroot, bytes(r.siblings).hex()) for r in merkle.prove(built).collect()]
    assert sorted(got) == sorted(want) and built.root == root


def test_nulls_repeats_long_texts_empty_tables_and_other_columns(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "x" * 300_000, "en", "s", 1), (3, "x" * 300_000, "en", "s", 1), (3, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as tree", "'x' as digest", "3 as `a.b`", "4 as `group`")
    want, root = expected([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r, strict=True)) for r in rows])
    built = merkle.build(docs, FIELDS)
    got = [(r.id, bytes(r.leaf).hex(), r.subroot, bytes(r.siblings).hex()) for r in merkle.prove(built).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and built.root == root
    nothing = merkle.build(docs.limit(0), FIELDS)
    assert nothing.root is None and merkle.prove(nothing).collect() == []
