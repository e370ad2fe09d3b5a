"""Repeated reads of an unchanged window, over a table of events; the streaming forms are in tessera.streaming."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.sources.staging import written

MAX_WINDOWS = 256
#: The tools that read, and where their arguments may name the file, in the order they are tried.
READ_TOOLS = ("read",)
PATH_KEYS = ("file_path", "path", "file", "filename")


def read_target(tool: Column, args: Column, tools: tuple[str, ...] = READ_TOOLS) -> Column:
    """The file, offset and limit that a read call (arguments as JSON) asks for; null for another call.

    The first of PATH_KEYS that is a string with text counts, trimmed; an offset or limit that is no number is null.
    """
    parsed = F.try_parse_json(args)

    def typed(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))

    paths = [F.when(typed(k) == "STRING", F.trim(F.try_variant_get(parsed, f"$.{k}", "string"))) for k in PATH_KEYS]
    path = F.coalesce(*[F.when(p != "", p) for p in paths])

    def number(name: str) -> Column:
        return F.when(typed(name).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(parsed, f"$.{name}", "double"))

    told = F.struct(path.alias("path"), number("offset").alias("offset"), number("limit").alias("limit"))
    return F.when(tool.isin(*tools) & path.isNotNull(), told)


def remembering(most: int):
    """A step over one session's rows in order: what is remembered are its windows, the latest read last, most at most."""
    known: dict = {}

    def step(window, stat, reset: bool, ok: bool) -> bool:
        if reset:
            known.clear()
            return False
        same = stat is not None and known.get(window) == stat
        if ok:
            known.pop(window, None)
            known[window] = stat
            if len(known) > most:
                del known[next(iter(known))]
        return same

    return known, step


def _text(columns: list[str]) -> Column:
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def repeated_reads(
    events: DataFrame, session: str, window: list[str], stat: str, order: list[str], reset: str, ok: str | None = None, most: int = MAX_WINDOWS
) -> DataFrame:
    """events with duplicate: whether the last successful read of the same window in the session, since its
    last reset, had the same stat and is still remembered: a session remembers the `most` windows that it read last.
    A null stat is unknown and never the same. Rows with reset set are no reads; a read for which ok is false is
    compared, but not remembered.

    The rows are cut into ranges of session and order, so that a session of any size is read by many tasks. What a
    session remembers where a range of it begins follows from the latest windows of its ranges before, `most` of each.
    The order columns tell the events of a session apart.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payload, keys = [f"p{i}" for i in range(len(events.columns))], [f"o{i}" for i in range(len(order))]
    told = events.select(
        F.col(session).alias("session"),
        *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)],
        _text(window).alias("window"),
        F.col(stat).cast("string").alias("stat"),
        F.coalesce(F.col(reset), F.lit(False)).alias("reset"),
        F.coalesce(F.col(ok), F.lit(False)).alias("ok") if ok else F.lit(True).alias("ok"),
        *[F.col(f"`{c}`").alias(p) for c, p in zip(events.columns, payload, strict=True)],
    )
    ranged = written(told.repartitionByRange(n, "session", *keys).withColumn("part", F.spark_partition_id()))
    place = F.struct(*keys)

    # sessions that go on from one range in another; in each range what they read since the last reset there
    pieces = ranged.groupBy("session", "part").agg(F.max(F.when(F.col("reset"), place)).alias("cleared"))
    over = pieces.groupBy("session").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("session").alias("s"))
    pieces = written(pieces.join(over, F.col("session").eqNullSafe(F.col("s")), "left_semi"))
    cut = pieces.select(F.col("session").alias("s"), F.col("part").alias("p"), "cleared")
    read = (
        ranged.where("ok and not reset")
        .join(cut, F.col("session").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .where(F.col("cleared").isNull() | (place > F.col("cleared")))
        .groupBy("session", "part", "window")
        .agg(F.max(F.struct(place.alias("at"), "stat")).alias("last"))
    )
    latest = Window.partitionBy("session", "part").orderBy(F.desc("last.at"))
    read = read.withColumn("age", F.row_number().over(latest)).where(F.col("age") <= most)
    marks = pieces.select("session", "part", F.lit(0).alias("age"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("string").alias("stat"), F.col("cleared").isNotNull().alias("reset"))
    summary = marks.unionByName(read.select("session", "part", "age", "window", "last.stat", F.lit(False).alias("reset")))
    kind = events.schema[session].dataType.simpleString()

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        known, step = remembering(most)
        out = []
        for part, rows in pdf.sort_values(["part", "age"], ascending=[True, False]).groupby("part", sort=True):
            out += [(rows["session"].iloc[0], part, i, w, s) for i, (w, s) in enumerate(known.items())]
            if rows["reset"].any():
                known.clear()
            for window, value, age in zip(rows["window"], rows["stat"], rows["age"], strict=True):
                if age:
                    step(window, value, False, True)
        return pd.DataFrame(out, columns=["session", "part", "at", "window", "stat"]).astype({"part": "int32", "at": "int32"})

    # of a session: as many rows as it has ranges, times `most`
    state = summary.groupBy("session").applyInPandas(carried, f"session {kind}, part int, at int, window string, stat string")
    rows = ranged.withColumns({"kind": F.lit(1), "at": F.lit(0)}).unionByName(state.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    fixed = ["part", "session", "kind", "window", "stat", "reset", "ok"]
    ordered = rows.repartition("part").sortWithinPartitions("part", "session", "kind", "at", *keys).select(*fixed, *payload)

    def run(batches):
        here, known, step = None, None, None
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(len(fixed))]
            out = []
            for part, who, is_event, asked, value, cleared, fine in zip(*values, strict=True):
                if step is None or (part, who) != here:
                    here, (known, step) = (part, who), remembering(most)
                if is_event:
                    out.append(step(asked, value, cleared, fine))
                else:
                    known[asked] = value
            kept = batch.filter(batch.column(2).cast(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns[len(fixed) :], pa.array(out, pa.bool_())], names=[*payload, "duplicate"])

    schema = StructType([StructField(p, f.dataType) for p, f in zip(payload, events.schema.fields, strict=True)] + [StructField("duplicate", BooleanType())])
    return ordered.mapInArrow(run, schema).toDF(*events.columns, "duplicate")
