"""The text index, layers and versions of the index, refresh without reading, and answers within a budget."""

import os
import random
import tracemalloc

import pyarrow as pa
import pytest

from tessera.functions import text as T
from tessera.operators import answer, search, text_index
from tessera.project import Project
from tessera.sources import index_store
from tessera.sources.staging import together, written

BODIES = [
    ("a", "The quick brown fox.\nÉtion que the lazy dog"), ("b", "quick-brown things; brown quick"), ("c", "日本語 text と the end"), ("d", ""), ("e", "!!! ---"),
    ("f", "other breathe them"), ("g", "thé au lait, the_end and the"), ("h", "x" * 200_000 + " the quick brown"), ("i", "the $end of validate_token(x)"), ("j", "validate_tokens validate_token2"),
]


def test_search_by_the_index_equals_the_scan(spark):
    docs = spark.createDataFrame(BODIES, "path string, body string")
    files = docs.selectExpr("path", "cast(ascii(path) as double) as importance")
    index = written(text_index.postings(docs), partition_by="bucket")
    for q in ("the", "quick brown", "quick-brown", "brown-quick", "ÉTION que", "日本", "本 日", "語", "!!!", "nowhere", "the !!!", "validate_token", "the_end", "x", " "):
        want = search.text_matches(docs, files, q, 20).collect()
        assert search.text_matches(docs, files, q, 20, index).collect() == want, q
        found = {r.path for r in text_index.matching(index, text_index.wanted(spark, q)).collect()}
        assert found == {r.path for r in search.phrase_matches(docs, q).collect()}, q


def test_a_search_reads_the_folders_of_its_words_only(spark):
    docs = spark.createDataFrame(BODIES + [(f"n{i}", f"word{i} common") for i in range(300)], "path string, body string")
    index = written(text_index.postings(docs), partition_by="bucket")
    asked = text_index.wanted(spark, "word7")
    found = text_index.matching(index, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(asked.buckets) == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term)" in plan.replace("In(term", "IsNotNull(term)")
    read = index.where(T.F.col("bucket").isin(asked.buckets)).select(T.F.input_file_name().alias("f")).distinct().collect()
    assert read and all(f"bucket={asked.buckets[0]}/" in r.f for r in read)


def test_postings_of_odd_texts_are_made_in_bounded_batches(spark, monkeypatch):
    texts = [None, "", "!!!", "the the of the", "Étion x² 日本 the", "of " * 3000 + "the", *(f"w{i} the w{i % 7}" for i in range(300))]
    own = spark.newSession()
    docs = own.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, body string")
    found = {(r.term, r.path): r.places for r in text_index.postings(docs).collect()}
    size = own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert int(size) <= 4 << 20  # a batch of 10,000 long texts doesn't fit a task
    want, forms = {}, docs.select("path", T.search_form(T.pad_cjk(T.F.col("body"))).alias("form")).collect()
    for r in forms:
        for at, term in enumerate((r.form or "").split()):
            want.setdefault((term, r.path), []).append(at)
    assert found == want
    monkeypatch.setattr(text_index, "ROWS", 37)
    batch = pa.RecordBatch.from_pydict({"path": [r.path for r in forms], "form": [r.form for r in forms]})
    parts = list(text_index.placed([batch.slice(0, 100), batch.slice(100)]))
    assert max(p.num_rows for p in parts) == 37
    assert {(r["term"], r["path"]): r["places"] for p in parts for r in p.to_pylist()} == want


def test_phrases_of_a_long_text_are_placed_in_little_memory(spark):
    long = " ".join(f"w{i % 900} the of" if i != 70_000 else "of the" for i in range(140_000))
    batch = pa.RecordBatch.from_pydict({"path": ["long"], "form": [f" {long} "]})
    tracemalloc.start()
    n = sum(p.num_rows for p in text_index.placed([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 902 and peak < 80 * 420_000  # 90 as Python strings and numbers
    docs = spark.createDataFrame([("long", long), ("one", "the of w"), ("none", "the w of")], "path string, body string")
    index = written(text_index.postings(docs), partition_by="bucket")
    of = lambda q: {r.path for r in text_index.matching(index, text_index.wanted(spark, q)).collect()}
    assert of("the-of") == {"long", "one"} and of("of-the") == {"long"} and of("of-the-the") == set()


def nodes_of(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes_of(plan.children().apply(i))


def test_a_search_with_many_candidates_shuffles_no_bodies(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text_index, "FEW", 3)
    spark.createDataFrame(BODIES, "path string, body string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    files = docs.selectExpr("path", "cast(ascii(path) as double) as importance")
    index, ranked = written(text_index.postings(docs), partition_by="bucket"), []
    monkeypatch.setattr(search, "written", lambda df: ranked.append(df) or written(df), raising=False)
    for q in ("the", "quick brown", "validate_token"):
        assert search.text_matches(docs, files, q, 20, index).collect() == search.text_matches(docs, files, q, 20).collect()
    plan = ranked[0]._jdf.queryExecution().optimizedPlan()  # what is ranked is found once, for the bodies too
    joins = [n for n in nodes_of(plan) if n.nodeName() == "Join"]
    assert len(ranked) == 3 and len(joins) == 2
    assert not any("body" in n.children().apply(i).output().mkString(",") for n in joins for i in (0, 1))


def tables_of(project):
    found, _ = index_store.read(project.spark, project.index)
    return {t: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for t, df in found.items() if t != "meta"}


def put(root, path, text):
    os.makedirs(os.path.dirname(root / path), exist_ok=True)
    (root / path).write_text(text)


def test_refresh_reads_what_changed_and_writes_no_more(spark, tmp_path):
    root = tmp_path / "tree"
    for i in range(30):
        put(root, f"src/m{i}.py", f"# module {i}\nfrom .m{(i * 7) % 30} import f\ndef f{i}():\n    f{(i + 1) % 30}()\n" + f"# filler {i}\n" * 300)
    put(root, "src/odd[1]{x}.py", "def odd():\n    pass\n")
    put(root, "notes.txt", "not indexed")
    (root / "src/bin.py").write_bytes(b"x\0y")
    project = Project(spark, str(tmp_path / "index"))
    project.scan(str(root))
    at = project.index

    # the text changes, neither size nor time do: a refresh that opened the file would see it
    old, stat = (root / "src/m3.py").read_text(), os.stat(root / "src/m3.py")
    (root / "src/m3.py").write_text(old.replace("module 3", "MODULE 3"))
    os.utime(root / "src/m3.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    size, _ = index_store.size_of(spark, at)
    assert {r.status for r in project.refresh(str(root)).collect()} == {"reused"}
    assert index_store.versions(spark, at) == [1] and index_store.size_of(spark, at)[0] == size
    (root / "src/m3.py").write_text(old)

    put(root, "src/m5.py", "def renewed():\n    odd()\n")
    put(root, "src/odd[1]{x}.py", "def odd():\n    return 2\n")
    (root / "src/m6.py").unlink()
    put(root, "new/fresh.py", "from .gone import y\ndef fresh():\n    renewed()\n")
    for name in ("src/m3.py", "src/m5.py", "src/odd[1]{x}.py"):
        os.utime(root / name, (10, 10))
    before = tables_of(project)
    diff = {r.path: r.status for r in project.refresh(str(root)).collect()}
    assert {p: s for p, s in diff.items() if s != "reused"} == {
        "src/m3.py": "updated", "src/m5.py": "updated", "src/odd[1]{x}.py": "updated", "src/m6.py": "removed", "new/fresh.py": "added",
    }
    assert index_store.size_of(spark, at)[0] - size < size
    again = Project(spark, str(tmp_path / "again"))
    again.scan(str(root))
    assert tables_of(project) == tables_of(again)
    first, _ = index_store.read(spark, at, 1)
    assert sorted(map(repr, first["symbols"].select(*sorted(first["symbols"].columns)).collect())) == before["symbols"]
    assert project.find("renewed").first().path == "src/m5.py" and project.find("filler 5").count() == 0


def test_layers_are_merged_and_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "index")
    imports = lambda *rows: spark.createDataFrame(rows, "path string, spec string")
    gone = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    index_store.write(spark, at, {"imports": imports(("a", "1"), ("b", "1"), ("c", "1"))})
    assert index_store.append(spark, at, 1, {"imports": imports(("a", "2"), ("d", "1"))}, gone("a")) == 2
    with pytest.raises(index_store.IndexMoved):
        index_store.append(spark, at, 1, {"imports": imports(("b", "2"))}, gone("b"))
    monkeypatch.setattr(index_store, "MAX_LAYERS", 2)
    assert index_store.append(spark, at, 2, {"imports": imports(("b", "3"))}, gone("b", "d")) == 3
    rows = lambda n: sorted(map(tuple, index_store.read(spark, at, n)[0]["imports"].collect()))
    assert rows(1) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert rows(2) == [("a", "2"), ("b", "1"), ("c", "1"), ("d", "1")]
    assert rows(3) == rows(None) == [("a", "2"), ("b", "3"), ("c", "1")]
    assert len(index_store.version_of(spark, at)["layers"]) == 1


def plain_fold(pieces, budget):
    spent, kept, cut, closed, ended, last = answer.RESERVED, [], False, None, False, False
    for hit, place, nth, kind, text, cost, rule in sorted(pieces):
        if ended or (rule == "list" and closed == (hit, place)) or (rule == "follows" and not last):
            last = False
            continue
        if spent + cost <= budget or rule == "always" or (rule == "stop" and not kept):
            spent, last = spent + cost, True
            kept.append((hit, place, nth, kind, text, cost))
            continue
        cut, last = True, False
        if rule == "stop":
            ended = True
        if rule == "list":
            closed = (hit, place)
    return kept, spent, cut


def test_the_fold_equals_a_loop_on_random_budgets(spark):
    rng = random.Random(12)
    for _ in range(12):
        pieces = []
        for hit in range(1, rng.randint(2, 12)):
            pieces.append((hit, 0, 0, "heading", f"h{hit}", rng.randint(3, 20), "stop"))
            for place, kind, rule, most in ((1, "description", "always", 1), (2, "callers", "always", 1), (3, "caller", "list", 6), (4, "more", "fits", 1), (6, "name", "list", 5), (7, "excerpt", "fits", 1), (8, "body", "fits", 1), (9, "more", "follows", 1)):
                pieces += [(hit, place, n, kind, f"{kind}{n}", rng.randint(1, 60), rule) for n in range(rng.randint(0, most))]
        budget = rng.randint(41, 500)
        df = spark.createDataFrame(pieces, answer.PIECES).repartition(3)
        found = answer.fold(df, budget).collect()
        kept, spent, cut = plain_fold([p for p in pieces if p[0] <= budget // 3 + 1], budget)
        assert [tuple(r)[:6] for r in found] == kept and {(r.spent, r.truncated) for r in found} == {(spent, cut)}


def test_an_answer_with_bodies_callers_and_names(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, "a.py", '# Tokens and more.\ndef validate():\n    """says"""\n    return 1\n\ndef validate_all():\n    validate()\n')
    put(root, "b.py", "from .a import validate\ndef use():\n    validate()\n    validate()\n# validate in words\n")
    put(root, "c.txt", "validate")
    put(root, "long.py", "def lengthy():\n" + "    x = 1\n" * 120)
    project = Project(spark, str(tmp_path / "index"))
    project.scan(str(root))
    rows = project.answer("validate", budget=4000, callers=5, per_file=3).collect()
    kinds = [r.kind for r in rows if r.hit == 1]
    assert kinds == ["heading", "description", "callers", "caller", "caller", "caller", "name", "body"]
    assert rows[0].text.startswith("a.py:2-4  function validate  [") and rows[1].text == "    Tokens and more."
    assert "return 1" in next(r.text for r in rows if r.kind == "body")
    assert {r.text.strip().split()[0] for r in rows if r.kind == "caller"} == {"a.py:7", "b.py:3", "b.py:4"}
    assert next(r.text for r in rows if r.kind == "name") == "    6-7  validate_all"
    assert rows[0].spent == 40 + sum(r.cost for r in rows) and not rows[0].truncated
    small = project.answer("validate", budget=60).collect()
    assert small[0].truncated and [r.kind for r in small][0] == "heading"
    cut, whole = (next(r for r in project.answer("lengthy", budget=4000, full=f).collect() if r.kind == "body") for f in (False, True))
    assert cut.text.count("\n") == 79 and whole.text.count("\n") == 120
    assert [r.kind for r in project.answer("lengthy", budget=4000).collect()][-1] == "more"
    said = project.summary().first()
    assert (said.symbol_source, said.files) == ("regex", 3) and said.said.startswith("3 files, ")


def test_jobs_side_by_side_come_back_in_order_and_the_first_error_is_raised(spark):
    """Errors wait for the other jobs; a layer with a table that cannot be made is not seen."""
    ended = []
    assert together(spark) == []
    assert together(spark, *[lambda i=i: spark.range(i).count() for i in range(12)]) == list(range(12))

    def broken():
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        together(spark, broken, lambda: ended.append(spark.range(1000).count()))
    assert ended == [1000]


def test_a_layer_that_fails_leaves_the_index_as_it_was(spark, tmp_path):
    at = str(tmp_path / "index")
    table = spark.createDataFrame([("a", "x")], "path string, spec string")

    def broken():
        raise ValueError("no ranks")

    index_store.write(spark, at, {"imports": table})
    with pytest.raises(ValueError, match="no ranks"):
        index_store.write(spark, at, {"imports": table.limit(0), "ranks": broken})
    found, meta = index_store.read(spark, at)
    assert found["imports"].count() == 1 and meta["number"] == 1
    made = lambda: spark.createDataFrame([("a", 2.0)], "path string, importance double")
    index_store.write(spark, at, {"imports": table, "ranks": made})
    assert [tuple(r) for r in index_store.read(spark, at)[0]["ranks"].collect()] == [("a", 2.0)]
