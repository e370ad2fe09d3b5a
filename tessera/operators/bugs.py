"""The bug log: an upsert by normalised symptom and a scored search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.staging import written

_COLUMNS = ["symptom", "error_message", "root_cause", "fix", "file", "line", "tags", "occurrences", "first_seen", "last_seen"]


def _latest(c: str, at: Column) -> Column:
    """The newest value that is not blank."""
    return F.max_by(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", at)).alias(c)


def tags_of(named: DataFrame) -> DataFrame:
    """(symptom, tags): repeats go before a symptom's tags are gathered, however many reports it has."""
    tags = named.select("symptom", F.explode("tags").alias("tag")).distinct()
    return tags.groupBy("symptom").agg(F.array_sort(F.collect_list(F.struct("tag"))["tag"]).alias("tags"))


def upsert(reports: DataFrame) -> DataFrame:
    """reports (error_message, root_cause, fix, file, line, tags, at, seq) folded into one bug per symptom.

    Symptoms are the same when equal after collapsing space and case. The newest non-blank fields stay, tags
    are united, ids follow first sight.
    """
    at = F.struct("at", "seq")
    named = reports.withColumn("symptom", T.normalise_symptom(F.col("error_message"))).where("symptom <> ''")
    merged = (
        named.groupBy("symptom")
        .agg(
            F.min_by("error_message", at).alias("error_message"),
            *[_latest(c, at) for c in ("root_cause", "fix", "file")],
            F.max_by("line", F.when(F.col("line").isNotNull(), at)).alias("line"),
            F.count(F.lit(1)).alias("occurrences"),
            F.min("at").alias("first_seen"),
            F.max("at").alias("last_seen"),
            F.min(at).alias("first"),
        )
    )
    none = F.array().cast(reports.schema["tags"].dataType)
    whole = merged.join(tags_of(named), "symptom", "left").withColumn("tags", F.coalesce("tags", none))
    return _numbered(whole, ["first", "symptom"]).withColumn("id", F.format_string("bug-%03d", "number")).select(*_COLUMNS, "id")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with number from 1 in the given order: by ranges, each on from the rows of those before it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, since another run could draw the ranges otherwise
    ranged = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
        .withColumn("number", within + F.col("_before"))
        .drop("_range", "_before")
    )


def merge(known: DataFrame, reports: DataFrame) -> DataFrame:
    """upsert onto an existing log: known bugs count with their occurrences and keep their first sight.

    New bugs get the numbers after the largest known one, by first sight, ranges at a time.
    """
    fresh = upsert(reports).drop("id")
    k = known.select(*[F.col(c).alias(f"k_{c}") for c in known.columns])
    both = written(fresh.join(k, F.col("symptom") == F.col("k_symptom"), "full_outer"))
    newest = both.agg(F.coalesce(F.max(F.regexp_extract("k_id", r"(\d+)$", 1).try_cast("int")), F.lit(0)).alias("n")).first().n
    numbered = _numbered(both.where("k_id is null"), ["first_seen", "symptom"])
    old = both.where("k_id is not null").withColumn("number", F.lit(0))
    every = numbered.unionByName(old)
    number = F.format_string("bug-%03d", (F.lit(newest) + F.col("number")).cast("int"))
    pick = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"k_{c}")).alias(c)
    none = F.array().cast("array<string>")
    return every.select(
        F.coalesce("k_id", number).alias("id"),
        F.coalesce("k_symptom", "symptom").alias("symptom"),
        F.coalesce("k_error_message", "error_message").alias("error_message"),
        *[pick(c) for c in ("root_cause", "fix", "file", "line")],
        F.array_union(F.coalesce("k_tags", none), F.coalesce("tags", none)).alias("tags"),
        (F.coalesce("k_occurrences", F.lit(0)) + F.coalesce("occurrences", F.lit(0))).alias("occurrences"),
        F.coalesce("k_first_seen", "first_seen").alias("first_seen"),
        F.coalesce("last_seen", "k_last_seen").alias("last_seen"),
    )


def search(bugs: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """20 for the symptom holding the term, 8 for any field, 3 for each of its words, up to 5 for occurrences."""
    needle = " ".join(term.lower().split())
    fields = ("error_message", "root_cause", "fix", "file")
    all_fields = F.lower(F.concat_ws("\n", *fields, F.concat_ws("\n", F.coalesce("tags", F.array().cast("array<string>")))))
    if not needle:
        return bugs.withColumn("score", F.lit(0).cast("long")).limit(0)
    score = F.when(F.contains("symptom", F.lit(needle)), 20).otherwise(0) + F.when(F.contains(all_fields, F.lit(needle)), 8).otherwise(0)
    seen = F.filter(F.array_distinct(T.words(F.lit(needle))), lambda w: F.contains(all_fields, w))
    score = score + 3 * F.size(seen)
    return (
        bugs.withColumn("score", score)
        .where("score > 0")
        .withColumn("score", (F.col("score") + F.least("occurrences", F.lit(5))).cast("long"))
        .orderBy(F.desc("score"), F.desc("last_seen"), "id")
        .limit(limit)
    )
