"""Shared helpers of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A null doc_id sorts before every other.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of the Arrow batches that tasks exchange with Python, and the setting that bounds them.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_LARGER = {"67108864", "67108864b", "64m", "64mb", str((1 << 31) - 1), f"{(1 << 31) - 1}b"}


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with as many underscores behind it as keep it apart from the columns taken."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Gives what a task has freed back to the system, as Python workers outlive their tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _released(f):
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def _bounded(spark: SparkSession) -> None:
    """A row-count bound alone lets long texts make batches of 64 MB; a session that sets its own bound keeps it."""
    if spark.conf.get(BATCH_SETTING, "67108864").lower() in _LARGER:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow over batches of about BATCH_BYTES (or one row); what a task used is given back when it ends.

    mapInArrow takes dots in the names of columns for fields; so it is given columns by number, and f their names.
    """
    _bounded(df.sparkSession)
    names = df.columns

    def named(batches):
        return f(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(_released(named), schema)


def map_pandas(df: DataFrame, f, schema) -> DataFrame:
    """mapInPandas in the same way."""
    _bounded(df.sparkSession)
    return df.mapInPandas(_released(f), schema)


#: Whether Spark removes the shuffle files of a query when the query ends, not when the driver next collects its garbage.
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """SHUFFLE_SETTING for the queries that end within; others keep what the session has."""
    before = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_SETTING)
        else:
            spark.conf.set(SHUFFLE_SETTING, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and returns them as read from there.

    This cuts the lineage: a lost executor costs no more than the tasks that read these files. What the query
    shuffled is of no use once they are written, and goes.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def text_sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def text_keys(digests: DataFrame) -> DataFrame | None:
    """A number (node) for each distinct doc and sha of digests, by doc, then sha; None if no doc has two of them.

    Ranges are numbered on their own, each on from the rows of those before it.
    """
    shas = digests.groupBy("doc").agg(F.min("sha").alias("low"), F.max("sha").alias("high"))
    with _shuffles_dropped(digests.sparkSession):
        if not shas.where("low <> high").limit(1).count():
            return None
    n = shuffle_partitions(digests.sparkSession)
    distinct = digests.select("doc", "sha").distinct()
    ranged = stage(distinct.repartitionByRange(n, "doc", "sha").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    # one row a range
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("range").orderBy("doc", "sha"))
    numbered = ranged.join(F.broadcast(counts.select("range", before.alias("before"))), "range")
    return stage(numbered.select("doc", "sha", (within + F.col("before")).cast("long").alias("node")), "text-keys")


def number_ranges(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Numbers the rows of each group in order (nulls first) without gathering a group in one task.

    Rows are dealt by ranges of group and order, rows that repeat both by where they come from too. The first table
    has all rows with range and nth (from 0, within group and range), the second range, group, rows, and before: how many
    rows of the group are in ranges before. before + nth is a row's number in its group.
    """
    tie = fresh(df.columns, "tie")[0]
    n = shuffle_partitions(df.sparkSession)
    dealt = df.withColumn(tie, F.spark_partition_id()).repartitionByRange(n, *group, *order, tie)
    ranged = stage(dealt.withColumn("range", F.spark_partition_id()), name)
    counts = ranged.groupBy("range", *group).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy("range", *group).orderBy(*order, tie)) - 1
    return ranged.withColumn("nth", nth).drop(tie), counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


#: A key is dealt over several tasks from so many rows on, or from an eighth of an average partition.
HOT_ROWS = 1024


def join_lists(left: DataFrame, right: DataFrame, key: list[str], by: str, size: str = "m") -> DataFrame:
    """left joined with right, one row a key that tells in size how many rows of left the key has (or more).

    The rows of a large key are dealt over tasks by a hash of the column by, each with a copy of its right row.
    Only the large keys are broadcast, fewer than eight a shuffle partition: each has an eighth of the rows that
    a partition has on average, or more.
    """
    parts, salt = fresh([*left.columns, *right.columns], "parts", "salt")
    total = right.agg(F.sum(size)).first()[0] or 0
    share = max(HOT_ROWS, total // (8 * shuffle_partitions(left.sparkSession)))
    split = F.ceil(F.col(size) / share).cast("int")
    large = right.where(F.col(size) > share).select(*key, split.alias(parts))
    dealt = left.join(F.broadcast(large), key, "left").withColumn(
        salt, F.when(F.col(parts).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col(parts)).cast("int"))
    )
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(size) > share, split).otherwise(1) - 1)))
    return dealt.drop(parts).join(copies, [*key, salt]).drop(salt)
