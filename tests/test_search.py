"""Search, read targets, capped text and hooks on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import bpe
from tessera.functions import text as T
from tessera.operators import calls, extract, guard, search, sweep
from tessera.sources import files, index_store


def test_text_search_takes_phrases_of_whole_words(spark):
    bodies = {
        "a": "alphabet soup", "b": "one alpha\ntwo alpha", "c": "ALPHA-beta", "d": "alpha then beta", "e": "Älpha alpha", "f": "日本語 text", "g": "x $alpha_1 y",
    }
    docs = spark.createDataFrame(list(bodies.items()), "path string, body string")
    rows = spark.createDataFrame([(p, 1.0) for p in bodies], "path string, importance double")

    def found(q):
        return [(r.path, r.weight, r.line) for r in search.text_matches(docs, rows, q, 10).collect()]

    assert found("alpha") == [("b", 10, 1), ("c", 5, 1), ("d", 5, 1), ("e", 5, 1), ("g", 5, 1)]
    assert found("alpha-beta") == [("c", 10, 1)]
    assert {p for p, _, _ in found("beta alpha")} == {"c", "d"}
    assert [p for p, _, _ in found("本")] == ["f"] and found("zzz") == [] and found(" ") == []
    assert [p for p, _, _ in found("alpha_1")] == [] and [p for p, _, _ in found("$alpha_1")] == ["g"]


def test_other_names_of_the_best_file(spark):
    s = spark.createDataFrame([("a", "token", "function", 3, 4), ("a", "tokenizer", "class", 1, 9), ("b", "my_token", "function", 1, 2)], "path string, name string, kind string, line int, end_line int")
    rows = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, None)], "path string, importance double, description string")
    docs = spark.createDataFrame([("a", "x")], "path string, body string")
    found = search.find(s, rows, docs, "token")
    assert [r.path for r in found.collect()] == ["a", "b"]
    assert [r.name for r in search.other_names(s, found, "token").collect()] == ["token", "tokenizer"]


def test_enclosing_keeps_repeated_rows(spark):
    points = spark.createDataFrame([("f", 3), ("f", 3), ("f", 9), (None, 3)], "path string, line int")
    spans = spark.createDataFrame([("f", 1, 5, "outer"), ("f", 2, 4, "inner")], "path string, s int, e int, name string")
    found = sweep.enclosing(points, spans, "path", "line", "s", "e", "name").collect()
    assert sorted((r.line, r.caller or "") for r in found) == [(3, ""), (3, "inner"), (3, "inner"), (9, "")]


def test_read_targets(spark):
    rows = [
        ("read", '{"file_path": " a.py ", "offset": 3}', ("a.py", 3.0, None)), ("read", '{"file_path": "", "path": "b"}', ("b", None, None)),
        ("read", '{"filename": "c", "limit": 2.5, "offset": "1"}', ("c", None, 2.5)), ("read", '{"path": 7}', None), ("write", '{"path": "x"}', None),
        ("read", "no json", None), ("read", None, None), ("read", "[1]", None),
    ]
    docs = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(rows)], "i int, tool string, args string")
    found = {r.i: r.t for r in docs.select("i", guard.read_target(F.col("tool"), F.col("args")).alias("t")).collect()}
    assert {i: tuple(t) if t else None for i, t in found.items()} == {i: want for i, (_, _, want) in enumerate(rows)}


def test_capped_text_and_oversized_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n" * 10)
    (tmp_path / "big.py").write_text("y" * (files.MAX_FILE_BYTES + 1))
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    found = {r.path.rsplit("/", 1)[-1]: r for r in files.capped_text(spark, str(tmp_path), 8).collect()}
    assert (found["a.py"].text, found["a.py"].bytes, found["a.py"].truncated) == ("x = 1\nx ", 60, True)
    assert not found["bin.py"].truncated
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(files.MAX_FILE_BYTES))
    try:
        listed = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert {p: r.readable for p, r in listed.items()} == {"a.py": True, "big.py": False, "bin.py": False}
    assert listed["big.py"].bytes == files.MAX_FILE_BYTES + 1


def test_hooks_for_analysis_and_token_counts(spark):
    code = spark.createDataFrame([("a.py", "py", "def f():\n    pass\n"), ("b.py", "py", "@@")], "path string, language string, content string")

    def analyzer(language, content):
        one = F.struct(F.lit("odd").alias("name"), F.lit("macro").alias("kind"), F.lit(1).alias("line"), F.lit(1).alias("end_line"))
        return F.when(content == "@@", F.array(one))

    found = {(r.path, r.name, r.kind) for r in extract.symbols(code, analyzer).collect()}
    assert found == {("a.py", "f", "function"), ("b.py", "odd", "macro")}
    listing = code.withColumns({"bytes": F.lit(1), "mtime_ms": F.lit(0.0)})
    rows = {r.path: r for r in extract.file_rows(listing, count_tokens=F.length, analyzer=analyzer).collect()}
    assert rows["a.py"].sym_source == "regex" and rows["b.py"].sym_source == "ts" and rows["b.py"].tokens == 2


def test_index_is_replaced_and_refused(spark, tmp_path):
    at = str(tmp_path / "index")
    with pytest.raises(index_store.IndexMissing):
        index_store.read(spark, at)
    table = spark.createDataFrame([("a", "./b")], "path string, spec string")
    first = index_store.write(spark, at, {"imports": table})
    second = index_store.write(spark, at, {"imports": table.limit(0)}, {"n": 2})
    found, meta = index_store.read(spark, at)
    assert first != second and found["imports"].count() == 0 and meta == {"n": 2, "number": 2}
    size, written = index_store.size_of(spark, at)
    assert size > 0 and written > 0
    (tmp_path / "index" / index_store.VERSIONS / "00000009.json").write_text('{"version": 0, "layers": [], "meta": {}}')
    with pytest.raises(index_store.IndexOutdated):
        index_store.read(spark, at)


def test_pad_cjk_and_clamp(spark):
    row = spark.createDataFrame([("日本x 한", "7.9", "no", None)], "t string, a string, b string, c string").select(
        T.pad_cjk(F.col("t")), *[T.clamp(F.col(c), 1, 5, 3) for c in "abc"]
    ).first()
    assert tuple(row) == ("日 本 x 한", 5, 3, 3)


def test_exact_token_counts_equal_the_library(spark):
    """Byte-level BPE from the specification, text by text."""
    import json
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("the vocabulary file is not here")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null")
    rows = docs.select("text", bpe.count_tokens(F.col("text"), spec).alias("n")).collect()
    assert [r.n for r in rows] == [len(x.ids) for x in library.encode_batch([r.text for r in rows], add_special_tokens=False)]


def test_pieces_counted_side_by_side_equal_the_library():
    """Odd strings, a block and the memory of counts much smaller than the pieces, and pieces without a space in them."""
    import json
    import os
    import random
    import time

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("the vocabulary file is not here")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rng = random.Random(7)
    odd = ["the", "  ", "\n", "\n\n", " ", "é", "日本", "0", "12", "'s", "'ll", "!?", "<|endoftext|>", "😀", "\t", "x" * 70, "ab" * 40, "=-=" * 30, "\u0301", "\r\n"]
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = ["", *("".join(rng.choices(odd, k=rng.randrange(25))) for _ in range(500)), *(letters(rng.randrange(140)) for _ in range(500)), "the of " * 5000]
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    model = bpe.Bpe(spec)
    assert model.count([None, *texts]) == [0, *want]
    old = bpe.BLOCK, bpe.COUNTED, bpe.LONG_TEXT
    bpe.BLOCK, bpe.COUNTED, bpe.LONG_TEXT = 50, 100, 1000
    try:
        assert model.count(texts) == want and len(model.counted) <= 150
    finally:
        bpe.BLOCK, bpe.COUNTED, bpe.LONG_TEXT = old
    assert [len(model.encode(t)) for t in texts[::7]] == want[::7]
    # its time must not grow with the square of a piece
    long = letters(100_000)
    began = time.process_time()
    ids = model.encode(long)
    assert time.process_time() - began < 20 and len(ids) == model.count([long])[0] == len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
