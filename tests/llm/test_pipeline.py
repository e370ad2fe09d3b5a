"""The pipeline's stages against plain Python on a small table."""

import re

import corpus_pipeline
from tessera.llm import mixing, sentencepiece_codec, toxicity
from tessera.llm.unigram import Units, Vocabulary, marked

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_equal_a_plain_version(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    said = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    want = {i for i in rows if not said[i]}
    assert {r.doc_id for r in clean.collect()} == want

    groups = {}
    for i in want:
        groups.setdefault(low(rows[i].text), []).append(i)
    unique = {max(g) for g in groups.values()}
    once = stages["exact_dedup"](spark, clean, SF)
    assert sorted(r.doc_id for r in once.collect()) == sorted(unique)

    sets, parent = {i: shingles(rows[i].text) for i in unique}, {i: i for i in unique}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in unique:
        for b in unique:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    apart = {i for i in unique if root(i) == i}
    near = stages["near_dedup"](spark, once, SF)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(apart)

    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) == apart
    labelled = mixing.labelled_languages(near, labels)
    rate = {r.doc_id: r.rate for r in mixing.rates(near, mixing.train(labelled, list(mixing.TARGETS)), mixing.TARGETS).collect()}
    least = max(0.25, min(rate.values()))
    assert all(abs(copies[i] - max(1.0, rate[i] / least)) < 1.0 + 1e-6 for i in apart)

    v = Vocabulary.load(sentencepiece_codec.VOCABULARY)
    units = Units(v)
    found = stages["sentencepiece"](spark, mixed, SF).collect()
    assert len(found) == sum(copies.values())
    assert all(list(r.ids) == units.encode(marked(rows[r.doc_id].text)) and r.n_tokens == len(r.ids) for r in found)


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as kept", "'x' as norm", "2 as bucket", "text as component", "3 as n", "4 as node", "5 as `a.b`")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(0), SF).collect() == [], name
        out = step(spark, docs.limit(40), SF)
        assert out.columns == docs.columns and out.count() > 0, name


def test_near_copies_are_decided_by_row_where_ids_are_null_or_repeated(spark):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(None, text("a")), (None, text("a") + " end"), (None, text("b")), (1, text("c")), (7, text("c") + " end"), (7, text("d")), (7, text("e")), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert near and all(r in rows for r in map(tuple, near))
    found = [tuple(r) for r in near]
    assert len(found) == 7 and sum(r in found for r in rows[:2]) == 1
    assert {rows[2], rows[3], rows[5], rows[6], rows[7], rows[8]} <= set(found) and rows[4] not in found
