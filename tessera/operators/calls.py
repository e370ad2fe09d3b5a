"""Attribution of call sites to the declarations they mean, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SELF = "self"
#: Over so many keys calls without a receiver are spread where receivers are joined.
SPREAD = 1024


def type_owners(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(type, owner): the first file that declares a type globally, else the first with a class of that name."""
    named = files.where("class_name is not null").select(F.col("class_name").alias("type"), "path", F.lit(0).alias("rank"))
    classes = symbols.where("kind = 'class'").select(F.col("name").alias("type"), "path", F.lit(1).alias("rank"))
    return named.unionByName(classes).groupBy("type").agg(F.min_by("path", F.struct("rank", "path")).alias("owner"))


def prune(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of names that are declared somewhere; a view, so that later declarations bring theirs back."""
    return calls.join(symbols.select("name"), "name", "left_semi")


def attribute(calls: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every call of a declared name with via and target.

    In this order: the file itself for a self receiver (self); the owner of the receiver's type (type); the
    file itself for a call without a receiver (self); the only file that declares the name (only); the one
    declaring file among the caller's imports (import); otherwise ambiguous, without a target.
    """
    declared = symbols.select("name", "path").distinct()
    spread = declared.groupBy("name").agg(F.count(F.lit(1)).alias("n_declaring"), F.min("path").alias("one"))
    owners = type_owners(files, symbols)
    here = declared.select("name", "path", F.lit(True).alias("here"))
    sites = calls.select("path", "name").distinct()
    reach = (
        sites.join(edges.select(F.col("src").alias("path"), "dst").distinct(), "path")
        .join(declared.select("name", F.col("path").alias("dst")), ["name", "dst"])
        .groupBy("path", "name")
        .agg(F.count(F.lit(1)).alias("n_reached"), F.min("dst").alias("reached"))
    )
    # a call without a receiver matches no type; such calls are spread by a key that none has
    spread_key = F.concat(F.lit("\0"), F.pmod(F.xxhash64("path", "line"), F.lit(SPREAD)).cast("string"))
    wanted = F.coalesce("receiver_type", "receiver", spread_key)
    owns = declared.select("name", F.col("path").alias("owner"), F.lit(True).alias("owns"))
    base = (
        calls.join(spread, "name")
        .join(here, ["name", "path"], "left")
        .join(reach, ["path", "name"], "left")
        .withColumn("type", wanted)
        .join(owners, "type", "left")
        .join(owns, ["name", "owner"], "left")
    )
    itself = F.col("receiver_type").eqNullSafe(F.lit(SELF))
    found_here = F.coalesce("here", F.lit(False))
    via = (
        F.when(itself & found_here, "self")
        .when(~itself & F.coalesce("owns", F.lit(False)), "type")
        .when((F.col("receiver").isNull() | itself) & found_here, "self")
        .when(F.col("n_declaring") == 1, "only")
        .when(F.col("n_reached") == 1, "import")
        .otherwise("ambiguous")
    )
    target = (
        F.when(F.col("via") == "self", F.col("path"))
        .when(F.col("via") == "type", F.col("owner"))
        .when(F.col("via") == "only", F.col("one"))
        .when(F.col("via") == "import", F.col("reached"))
    )
    return base.withColumn("via", via).select(*calls.columns, "n_declaring", "via", target.alias("target"))


def report(attributed: DataFrame, name: str, path: str) -> DataFrame:
    """One row on the callers of a declaration: counts by reason, of calls meant elsewhere, and undecided."""
    mine = F.col("target") == path
    count = lambda c: F.count_if(c)
    return attributed.where(F.col("name") == name).agg(
        F.count(F.lit(1)).alias("total"),
        *[count(mine & (F.col("via") == v)).alias(f"via_{v}") for v in ("self", "type", "only", "import")],
        count(F.col("target").isNotNull() & ~mine).alias("elsewhere"),
        count(F.col("via") == "ambiguous").alias("ambiguous"),
    )


def top_callers(attributed: DataFrame, files: DataFrame, name: str, path: str, limit: int = 20) -> DataFrame:
    """The callers of a declaration from the most important files on."""
    return (
        attributed.where((F.col("name") == name) & (F.col("target") == path))
        .join(files.select("path", "importance"), "path")
        .orderBy(F.desc("importance"), "path", "line")
        .limit(limit)
    )
