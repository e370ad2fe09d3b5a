"""Jump hashing, places and files of shards."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 1000])
def test_jump_is_the_published_function(shards):
    keys = [*range(300), (1 << 64) - 1, 1 << 63, 12345678901234567890]
    assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_more_shards_take_rows_only_into_themselves():
    keys = np.arange(200_000, dtype=np.uint64)
    before = sharding.jump(keys, 8)
    assert np.bincount(before).max() < 1.02 * len(keys) / 8
    for grown in (9, 12):
        after = sharding.jump(keys, grown)
        moved = before != after
        assert (after[moved] >= 8).all() and abs(moved.mean() - (grown - 8) / grown) < 0.01


def test_manifest_by_a_plain_loop(spark):
    rows = [(i, None if i % 10 == 0 else "é" * (i % 7), i, "x") for i in range(-40, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, `a.b` string")
    got = {r.doc_id: r for r in sharding.manifest(docs, 8).collect()}
    assert len(got) == len(rows)
    shards = {}
    for i, text, _, _ in rows:
        r, data = got[i], (text or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), plain_jump(i % (1 << 64), 8), plain_jump(i % (1 << 64), 9))
        shards.setdefault(r.shard, []).append(r.slot)
    for slots in shards.values():
        assert slots == list(range(len(slots)))


def test_null_and_repeated_ids_names_and_empty_tables(spark):
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c"), (7, None)] + [(9, "same")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    out = sharding.place(docs, 3, shard_as="s", slot_as="n")
    assert out.columns == [*docs.columns, "s", "n"]
    found = out.collect()
    assert sorted(repr(tuple(r)[:2]) for r in found) == sorted(map(repr, rows))
    for s in {r.s for r in found}:
        assert sorted(r.n for r in found if r.s == s) == list(range(sum(r.s == s for r in found)))
    assert sharding.place(docs.limit(0), 3).collect() == []
    named = spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string")
    assert {r.shard for r in sharding.place(named, 1).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.place(named, 0)


def test_files_of_shards_and_rows_that_move(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text", "'mine' as shard")
    sharding.write(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in docs.collect())
    for s in range(4):
        part = spark.read.parquet(str(tmp_path / "out" / f"shard_={s}"))
        assert sorted(r.slot for r in part.select("slot").collect()) == list(range(part.count()))
        assert {r.doc_id for r in part.collect()} == {i for i in range(2000) if plain_jump(i, 4) == s}
    gone = sharding.moved(docs, 4, 5).collect()
    assert {(r.doc_id, r.from_shard, r.to_shard) for r in gone} == {(i, plain_jump(i, 4), 4) for i in range(2000) if plain_jump(i, 4) != plain_jump(i, 5)}
