"""The index on disk: layers of Parquet tables, and numbered versions that say which layers count.

A version is a small file that lists its layers, oldest first. A layer holds the rows of some files, and in `gone` the
paths whose rows of older layers no longer count; readers take all layers and leave those rows out. So a change writes
the changed files' rows and a version, and no more; once there are MAX_LAYERS layers the next change writes one new
layer of everything. Tables of WHOLE are not kept by path: the latest layer that has one counts.

A version becomes visible by one rename that fails if its number is taken: of two writers that started from the same
version one is told so and begins anew. Older versions stay readable. Tables are sorted by path (postings by word), in
row groups with bloom filters, so that few of them are read for a path or a word. Everything goes through the Hadoop
file system of the path.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import INDEX_VERSION, STORED
from tessera.sources.staging import together

VERSIONS = "_versions"
WHOLE = ("coverage", "ranks", "meta")
MAX_LAYERS = 8
#: Bytes of a row group of the tables that are looked up by path or word.
ROW_GROUP = 4 << 20


class IndexMissing(Exception):
    """There is no index at the path."""


class IndexOutdated(Exception):
    """The index was written by another version of the format."""


class IndexMoved(Exception):
    """Another writer made the next version first."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions there are."""
    folder, fs = _fs(spark, f"{root}/{VERSIONS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")


def version_of(spark: SparkSession, root: str, number: int | None = None) -> dict:
    known = versions(spark, root)
    if not known or (number is not None and number not in known):
        raise IndexMissing(root)
    path, fs = _fs(spark, f"{root}/{VERSIONS}/{known[-1] if number is None else number:08d}.json")
    stream = fs.open(path)
    try:
        found = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    if found["version"] != INDEX_VERSION:
        raise IndexOutdated(f"{root} has version {found['version']}, {INDEX_VERSION} is read")
    return found


def publish(spark: SparkSession, root: str, number: int, layers: list[dict], meta: dict) -> None:
    """Makes a version visible, or raises IndexMoved if there is one of its number."""
    text = json.dumps({"version": INDEX_VERSION, "number": number, "layers": layers, "meta": meta})
    new, fs = _fs(spark, f"{root}/{VERSIONS}/.{number:08d}.{time.time_ns()}")
    out = fs.create(new)
    out.write(bytearray(text, "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = getattr(hadoop.Options.Rename, "NONE")
    target = fs.makeQualified(_fs(spark, f"{root}/{VERSIONS}/{number:08d}.json")[0])
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), target, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise IndexMoved(f"{root} has a version {number} by another writer") from e
        raise


def _sorted(df: DataFrame, table: str) -> DataFrame:
    order = ["bucket", "term", "path"] if table == "postings" else ["path"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _write_table(at: str, table: str, found: DataFrame | Callable[[], DataFrame]) -> None:
    found = found() if callable(found) else found
    found = found.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in STORED[table]])
    if table in WHOLE:
        found.write.parquet(f"{at}/{table}")
        return
    writer = _sorted(found, table).write.option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.enabled#path", "true")
    if table == "postings":
        writer = writer.option("parquet.bloom.filter.enabled#term", "true").partitionBy("bucket")
    writer.parquet(f"{at}/{table}")


def _write_layer(spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> dict:
    """Writes the tables side by side; one may be a function that makes it, which then runs beside the others' writes."""
    name = f"layer-{time.time_ns()}"
    if isinstance(tables.get("files"), DataFrame) and "importance" in tables["files"].columns:
        tables = tables | {"ranks": tables["files"].select("path", "importance")}
    held = [table for table in STORED if table in tables]
    # those that are made here take longest and begin first
    first = sorted(held, key=lambda table: not callable(tables[table]))
    together(spark, *[partial(_write_table, f"{root}/{name}", table, tables[table]) for table in first])
    return {"name": name, "tables": held}


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable[[], DataFrame]], meta: dict | None = None) -> str:
    """Writes all tables as one layer and makes it the next version; its name comes back."""
    layer = _write_layer(spark, root, tables)
    while True:
        number = (versions(spark, root) or [0])[-1] + 1
        try:
            publish(spark, root, number, [layer], meta or {})
            return layer["name"]
        except IndexMoved:  # the whole index is replaced, whatever the other writer did
            continue


def append(
    spark: SparkSession, root: str, after: int, tables: dict[str, DataFrame | Callable[[], DataFrame]], gone: DataFrame, meta: dict | None = None
) -> int:
    """The next version after `after`: rows of older layers of the paths in gone go, those of tables come.

    If there is a version after `after` already, IndexMoved is raised and nothing changes.
    """
    before = version_of(spark, root, after)
    if versions(spark, root)[-1] != after:
        raise IndexMoved(f"{root} went on from version {after}")
    layer = _write_layer(spark, root, tables | {"gone": gone})
    layers = [*before["layers"], layer]
    if len(layers) > MAX_LAYERS:
        layers = [_write_layer(spark, root, _merged(spark, root, layers))]
    publish(spark, root, after + 1, layers, {**before["meta"], **(meta or {})})
    return after + 1


def _merged(spark: SparkSession, root: str, layers: list[dict]) -> dict[str, DataFrame]:
    gone, found = None, {}
    for i, layer in enumerate(layers):
        if "gone" in layer["tables"]:
            paths = spark.read.schema(STORED["gone"]).parquet(f"{root}/{layer['name']}/gone").select(F.col("path").alias("gone_path"), F.lit(i).alias("upto"))
            gone = paths if gone is None else gone.unionByName(paths)
    if gone is not None:
        gone = gone.groupBy("gone_path").agg(F.max("upto").alias("upto"))
    for table, schema in STORED.items():
        if table == "gone":
            continue
        having = [i for i, layer in enumerate(layers) if table in layer["tables"]]
        if not having:
            continue
        read = {i: spark.read.schema(schema).parquet(f"{root}/{layers[i]['name']}/{table}") for i in having}
        if table in WHOLE:
            found[table] = read[having[-1]]
        elif gone is None:
            found[table] = read[having[-1]]
        else:
            rows = None
            for i, df in read.items():
                df = df.withColumn("layer", F.lit(i))
                rows = df if rows is None else rows.unionByName(df)
            found[table] = rows.join(gone, (F.col("path") == F.col("gone_path")) & (F.col("layer") < F.col("upto")), "left_anti").drop("layer")
    return found


def read(spark: SparkSession, root: str, number: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables and meta values of a version, the latest if none is said; an index of another format is refused."""
    version = version_of(spark, root, number)
    found = _merged(spark, root, version["layers"])
    if "files" in found and "ranks" in found:
        found["files"] = found["files"].join(found["ranks"], "path", "left")
    return found, version["meta"] | {"number": version["number"]}


def size_of(spark: SparkSession, root: str) -> tuple[int, int]:
    """Bytes below the root, and when the latest version was written in milliseconds."""
    folder, fs = _fs(spark, root)
    latest, _ = _fs(spark, f"{root}/{VERSIONS}/{versions(spark, root)[-1]:08d}.json")
    return fs.getContentSummary(folder).getLength(), fs.getFileStatus(latest).getModificationTime()
