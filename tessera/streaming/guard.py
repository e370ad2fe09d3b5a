"""The read guard as a stream: per session the last stat of each window is kept in a table between micro-batches."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.guard import MAX_WINDOWS
from tessera.sources.staging import shared_folder


#: A row is a remembered window of a session (kind 0, in the order at) or an event (kind 1).
_STATE, _EVENT = 0, 1
_DECIDED = "kind int, session string, event {}, duplicate boolean, window string, stat string, at int"


def _processor(most: int):
    """Batches of rows sorted by session, state before events, to decisions and each session's new state.

    What is held of a session is its windows, most at most, and the rows of one batch.
    """

    def run(batches):
        current, known, kind_of = None, None, None

        def state():
            return [(_STATE, current, None, None, w, s, i) for i, (w, s) in enumerate((known or {}).items())]

        def batch_of(rows):
            types = [pa.int32(), pa.string(), kind_of, pa.bool_(), pa.string(), pa.string(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            names = ["kind", "session", "event", "duplicate", "window", "stat", "at"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            kind_of = batch.schema.field("event").type
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "session", "event", "window", "stat", "reset", "ok")]
            out = []
            for kind, session, event, window, stat, reset, ok in zip(*values, strict=True):
                if known is None or session != current:
                    out += state()
                    current, known = session, {}
                if kind == _STATE:
                    known[window] = stat
                    continue
                if reset:
                    known.clear()
                    out.append((_EVENT, session, event, False, None, None, None))
                    continue
                out.append((_EVENT, session, event, stat is not None and known.get(window) == stat, None, None, None))
                if ok:
                    known.pop(window, None)
                    known[window] = stat
                    if len(known) > most:
                        del known[next(iter(known))]
            yield batch_of(out)
        if known:
            yield batch_of(state())

    return run


def repeated_reads(events: DataFrame, state: DataFrame | None, order: list[str], most: int = MAX_WINDOWS) -> DataFrame:
    """Decisions (kind 1: session, event, duplicate) on a micro-batch of (session, event, window, stat, reset, ok)
    and the order columns, and the state after it (kind 0: session, window, stat, at). state is the result for
    the micro-batch before.

    A session keeps its most recent windows up to the bound; the oldest goes first. Sessions themselves are
    not bounded by number. A session's events are read in order by one task, sorted by Spark, which spills.
    """
    kind = events.schema["event"].dataType.simpleString()
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = events.select(F.lit(_EVENT).alias("kind"), "session", "event", "window", "stat", "reset", "ok", F.lit(0).alias("at"), *keys)
    if state is not None:
        rows = rows.unionByName(state.where(F.col("kind") == _STATE).select("kind", "session", "window", "stat", "at"), allowMissingColumns=True)
    ordered = rows.repartition("session").sortWithinPartitions("session", "kind", "at", *[f"_o{i}" for i in range(len(order))])
    return ordered.mapInArrow(_processor(most), _DECIDED.format(kind))


def over_parquet(
    spark: SparkSession, path: str, session: str, window: str, stat: str, order: list[str], reset: str, event: str
) -> DataFrame:
    """The guard over a Parquet table read as a stream until it is used up; decisions as (event, duplicate)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema)
    # a table is a folder of files or one file; a stream reads folders only
    stream = source.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else source.parquet(path)
    events = stream.select(
        F.col(session).cast("string").alias("session"),
        F.col(event).alias("event"),
        F.col(window).cast("string").alias("window"),
        F.col(stat).cast("string").alias("stat"),
        F.expr(reset).alias("reset"),
        F.lit(True).alias("ok"),
        *[c for c in order if c != event],
    )
    by = ["event" if c == event else c for c in order]
    base = f"{shared_folder(spark).rstrip('/')}/guard-{uuid.uuid4().hex}"
    form = _DECIDED.format(schema[event].dataType.simpleString())
    done: list[str] = []

    def decide(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = session.read.schema(form).parquet(done[-1]) if done else None
        repeated_reads(batch, state, by).write.parquet(f"{base}/out-{number}")
        done.append(f"{base}/out-{number}")

    query = events.writeStream.foreachBatch(decide).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(form).parquet(*done) if done else spark.createDataFrame([], form)
    return found.where(F.col("kind") == _EVENT).select(F.col("event").alias(event), "duplicate")


def _is_file(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile()
