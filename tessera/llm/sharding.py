"""Sharding by jump consistent hashing: a stable key and the number of shards say where a row goes.

There is no ring and no table of shards: a row's place follows from its key in about ln(shards) steps of a linear
congruence (Lamping and Veach, 2014). With one shard more, each row stays where it is or moves to the new shard, and
one row in shards + 1 does.

Slots (places within a shard, without gaps) come from ranges of shard and key, so that no task holds a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, number_ranges

_FACTOR = np.uint64(2862933555777941757)
#: Files that write makes of each shard, by default.
FILES = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key (unsigned 64-bit integers), 0 to shards - 1."""
    key, b = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    at, live, place = np.arange(len(keys)), key, np.zeros(len(keys), np.int64)
    while len(at):
        b[at] = place
        with np.errstate(over="ignore"):
            live = live * _FACTOR + np.uint64(1)
        place = ((place + 1) * (float(1 << 31) / ((live >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        more = place < shards
        at, live, place = at[more], live[more], place[more]
    return b


def key_of(df: DataFrame, column: str) -> Column:
    """A row's key: the integers of an integer column as they are (null as 0), else a 64-bit hash of the value."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(0)) if whole else F.xxhash64(F.col(f"`{column}`"))


def shard_of(key: Column, shards: int) -> Column:
    if not 1 <= shards < 1 << 31:
        raise ValueError("from 1 to 2^31 - 1 shards")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards), dtype=np.int32)

    return place(key)


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", shard_as: str = "shard", slot_as: str = "slot") -> DataFrame:
    """docs with two more columns: the shard (int) of each row and its slot (long, from 0 without gaps) in it.

    Slots ascend by id (null first); of rows that repeat an id the order is that of where they are read. The number
    of shards and the id alone say the shard: a null id counts as 0, ids that are not integers by their hash. An
    empty table stays empty, columns are kept whatever their names; texts of any length are rows like others.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*columns).alias("row"), F.col(f"`{id_col}`").alias("id"), shard_of(key_of(docs, id_col), shards).alias("shard"))
    ranged, counts = number_ranges(held, ["shard"], ["id"], "shards")
    # one row a range, and one more a shard
    start = counts.select(F.col("range").alias("range_"), F.col("shard").alias("shard_"), "before")
    joined = ranged.join(start, (F.col("range") == F.col("range_")) & (F.col("shard") == F.col("shard_")))
    return joined.select("row.*", F.col("shard").alias(shard_as), (F.col("before") + F.col("nth")).cast("long").alias(slot_as))


def manifest(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What goes where: doc_id, size (UTF-8 bytes of the text and one), text_crc32, shard, slot, grown_shard (with a shard more).

    A null text has no bytes. Texts are read once and only their sizes and sums are sorted. Nulls in ids, repeated
    rows and empty tables go as in place; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    light = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return place(light, shards).withColumn("grown_shard", shard_of(key_of(light, "doc_id"), shards + 1))


def write(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", files: int = FILES) -> None:
    """The rows as Parquet, one folder shard=N for each shard, with their slots, in `files` files of ascending slots each.

    Nulls, repeated rows and columns go as in place; the columns shard and slot get underscores where docs has such.
    """
    shard, slot = fresh(docs.columns, "shard", "slot")
    placed = place(docs, shards, id_col, shard, slot)
    placed.repartitionByRange(shards * files, F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def moved(docs: DataFrame, shards: int, grown: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that change their shard when there are grown shards, with the columns from_shard and to_shard.

    With more shards all of them move to new ones. Nulls, repeated rows, empty tables and columns go as in place.
    """
    before, after = fresh(docs.columns, "from_shard", "to_shard")
    key = key_of(docs, id_col)
    return docs.withColumns({before: shard_of(key, shards), after: shard_of(key, grown)}).where(F.col(before) != F.col(after))
