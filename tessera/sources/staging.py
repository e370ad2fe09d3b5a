"""Where intermediate results are kept: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: So many jobs are handed to Spark side by side.
SIDE_BY_SIDE = 8


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The rows as written once to the shared folder and read from there: no lineage, and each is computed once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *jobs: Callable) -> list:
    """The results of jobs that don't need each other, in order, run side by side.

    The cores that one job's last tasks leave idle go to the next, and small jobs don't wait for each other's start.
    The first error among them is raised once all have ended.
    """
    with ThreadPoolExecutor(max(1, min(SIDE_BY_SIDE, len(jobs)))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]
