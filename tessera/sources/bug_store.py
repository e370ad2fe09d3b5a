"""The bug log as a table that is written back: each change is a numbered version that names its folder.

A change reads the latest version, merges the reports into it and makes the next one visible by a rename that fails if
its number is taken; then it begins again from what the other writer left, so that two writers lose nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import bugs
from tessera.sources import index_store

COLUMNS = (
    "id string, symptom string, error_message string, root_cause string, fix string, file string, line int, tags array<string>, "
    "occurrences long, first_seen timestamp, last_seen timestamp"
)


def read(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The log and the number of its version; an empty one of number 0 where there is none."""
    if not index_store.versions(spark, root):
        return spark.createDataFrame([], COLUMNS), 0
    version = index_store.version_of(spark, root)
    return spark.read.schema(COLUMNS).parquet(f"{root}/{version['layers'][0]['name']}"), version["number"]


def add(spark: SparkSession, root: str, reports: DataFrame) -> int:
    """Merges reports (as bugs.upsert takes them) into the log; the number of the new version comes back."""
    while True:
        known, number = read(spark, root)
        name = f"bugs-{uuid.uuid4().hex}"
        merged = bugs.merge(known, reports)
        fields = spark.createDataFrame([], COLUMNS).schema
        merged.select(*[merged[f.name].cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{root}/{name}")
        try:
            index_store.publish(spark, root, number + 1, [{"name": name, "tables": ["bugs"]}], {})
            return number + 1
        except index_store.IndexMoved:
            continue
