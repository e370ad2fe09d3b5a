"""Keeping an index current: what changed, what is stale, and the rows to replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", stamp: tuple[str, ...] = ("mtime_ms", "bytes")) -> DataFrame:
    """Per key of either side: added, removed, updated (a stamp differs) or reused."""
    a = old.select(F.col(key), F.struct(*stamp).alias("before"))
    b = new.select(F.col(key), F.struct(*stamp).alias("after"))
    status = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "updated")
        .otherwise("reused")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def stale(stored: DataFrame, listing: DataFrame, key: str = "path", stamp: str = "mtime_ms") -> DataFrame:
    """Stored keys that are missing now, or whose time differs."""
    now = listing.select(F.col(key), F.col(stamp).alias("now"), F.lit(True).alias("there"))
    return (
        stored.select(key, F.col(stamp).alias("then"))
        .join(now, key, "left")
        .select(key, F.when(F.col("there").isNull(), "missing").when(~F.col("now").eqNullSafe(F.col("then")), "changed").alias("state"))
        .where("state is not null")
    )


def sync(old: DataFrame, new: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """old without what was removed or updated, and new's rows of what was added or updated."""
    gone = diff.where("status in ('removed', 'updated')").select(key)
    came = diff.where("status in ('added', 'updated')").select(key)
    return old.join(gone, key, "left_anti").unionByName(new.join(came, key, "left_semi"))
