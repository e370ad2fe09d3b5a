"""Exact deduplication by content sort, with DataFrame operations only.

Sampled splitters deal the normalised texts out by range of a bounded key (their first characters, a hash of
the whole and the id, all in hexadecimal), so that the copies of one text lie next to each other in one bucket or in
consecutive ones: a group of any size is spread. Within a bucket Spark's external sort puts equal texts
next to each other and each is compared in full with the one before it. Only the first and the last runs of
a bucket can go on in another; those few (two a bucket) are put together by the SHA-256 of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, shuffle_partitions, stage

PREFIX_CHARS = 24
SAMPLES_PER_BUCKET = 20


def _bucket(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at most the key, by binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    sorted_keys = F.array(*[F.lit(s) for s in splitters])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(sorted_keys, at + step - 1) <= key, at + step).otherwise(at),
    )


def _grouped(rows: DataFrame, buckets: int | None, payload: list[str], survivors: bool) -> DataFrame:
    """rows (__id, __norm and payload) with their group: keep, size, kept, sha and the payload.

    One expression, place, orders rows both across buckets and within one: the hexadecimal first characters and
    the hash of the text, both of which hold no separator, so that what continues in the next bucket is the last
    run of this one. survivors: rows that another row of their bucket displaces are left out early.
    """
    spark = rows.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    keyed = rows.withColumn(
        "__place",
        F.concat(F.hex(F.substring("__norm", 1, PREFIX_CHARS)), F.lit("."), F.lpad(F.hex(F.xxhash64("__norm")), 16, "0")),
    )
    key = F.concat("__place", F.lit("."), F.coalesce(F.hex(F.col("__id").cast("string")), F.lit("")))
    fraction = min(1.0, SAMPLES_PER_BUCKET * n / max(1, rows.count()))
    sampled = sorted(r.key for r in keyed.sample(False, fraction, 7).select(key.alias("key")).collect())
    every = max(1, len(sampled) // n)
    splitters = sorted(set(sampled[every - 1 :: every]))

    in_order = Window.partitionBy("__bucket").orderBy("__place", "__norm", F.desc("__id"))
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = F.coalesce(F.lag("__norm").over(in_order) == F.col("__norm"), F.lit(False))
    place = F.col("__place")
    runs = keyed.withColumn("__bucket", _bucket(key, splitters)).select(
        *payload,
        "__id",
        "__bucket",
        F.sha2("__norm", 256).alias("__sha"),
        ((F.first(place).over(whole) == place) | (F.last(place).over(whole) == place)).alias("__edge"),
        *([same.alias("__same")] if survivors else [F.sum(F.when(same, 0).otherwise(1)).over(in_order).alias("__run")]),
    )
    if survivors:  # the first row of a run has its largest id
        local = runs.where("not __same").withColumns({"__top": F.col("__id"), "__size": F.lit(1).cast("long"), "__nth": F.lit(1)})
    else:
        run = Window.partitionBy("__bucket", "__run")
        local = runs.select(
            *payload,
            "__id",
            "__sha",
            "__edge",
            F.max("__id").over(run).alias("__top"),
            F.count(F.lit(1)).over(run).alias("__size"),
            F.row_number().over(run.orderBy(F.desc("__id"))).alias("__nth"),
        )
    local = stage(local, "runs")
    # two runs a bucket at most, but for hash collisions: bounded by the number of buckets
    across = (
        local.where(F.col("__edge") & (F.col("__nth") == 1))
        .groupBy(F.col("__sha").alias("__text"))
        .agg(F.max("__top").alias("__all_top"), F.sum("__size").alias("__all_size"))
    )
    joined = local.join(F.broadcast(across), F.col("__sha") == F.col("__text"), "left")
    keep = F.when(F.col("__text").isNull(), F.col("__top")).otherwise(F.col("__all_top"))
    return joined.select(
        *payload,
        "__id",
        "__sha",
        keep.alias("__keep"),
        F.coalesce("__all_size", "__size").alias("__group"),
        (F.col("__id").eqNullSafe(keep) & (F.col("__nth") == 1)).alias("__kept"),
    )


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Every row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The largest id of a
    group stays. Null ids are smaller than all others; a group with null ids only keeps one of them. Of
    rows that repeat both id and text one is kept. A text of any length is one value of the sort and of the
    comparison. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("__id"), ascii_lower(F.col(text_col)).alias("__norm"))
    return _grouped(rows, buckets, [], False).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__group").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The rows of docs that find_copies keeps, with all their columns, whatever their names.

    Nulls, empty texts, ties and repeated rows go as in find_copies; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("__row"), F.col(id_col).alias("__id"), ascii_lower(F.col(text_col)).alias("__norm"))
    return _grouped(rows, buckets, ["__row"], True).where("__kept").select("__row.*")
