"""One pass over rows in order of a key and a place, with a stack of what is open: nested and overlapping intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Open:
    """Spans that started, the latest last. What has ended is dropped when it comes to the top."""

    def __init__(self):
        self.spans: list[tuple] = []

    def innermost(self, at) -> object:
        """The value of the latest start among the spans that reach at; at never falls."""
        while self.spans and self.spans[-1][0] < at:
            self.spans.pop()
        return self.spans[-1][1] if self.spans else None


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, found_as: str = "caller") -> DataFrame:
    """points with the name of the innermost span (greatest start, then name) of their key that covers them, else null.

    Points and the starts of spans are one table, sorted by key and place: each key is read once, whatever the number
    of its spans, and the memory of a task is the spans that are open at one place. Repeated points stay; a null key
    or place is covered by nothing, a span with a null covers nothing.
    """
    kind = points.schema[at].dataType
    payload = [F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(points.columns)]
    none = [F.lit(None).cast(f.dataType).alias(f"p{i}") for i, f in enumerate(points.schema.fields)]
    held = points.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast(kind).alias("end"), F.lit(None).cast("string").alias("name"), *payload)
    opened = spans.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(key).alias("key"), F.col(start).cast(kind).alias("at"), F.lit(0).alias("turn"), F.col(end).cast(kind).alias("end"), F.col(name).cast("string").alias("name"), *none
    )

    def run(batches: Iterator[pa.RecordBatch]):
        here, stack = None, Open()
        for batch in batches:
            keys, places, turns, ends, names = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for k, place, turn, stop, called in zip(keys, places, turns, ends, names, strict=True):
                if k != here:
                    here, stack = k, Open()
                if turn == 0:
                    stack.spans.append((stop, called))
                else:
                    out.append(None if k is None or place is None else stack.innermost(place))
            kept = batch.filter(pa.array(turns, pa.int32()).cast(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns[5:], pa.array(out, pa.string())], names=[*kept.schema.names[5:], "found"])

    schema = T.StructType([T.StructField(f"p{i}", f.dataType) for i, f in enumerate(points.schema.fields)] + [T.StructField("found", T.StringType())])
    ordered = held.unionByName(opened).repartition("key").sortWithinPartitions("key", "at", "turn", "name")
    return ordered.mapInArrow(run, schema).toDF(*points.columns, found_as)


def bodies(lines: Iterator[dict]) -> Iterator[tuple]:
    """(path, name, kind, line, end_line) of the declarations of lines in order.

    A line has path, line, blank, indent, step (brackets opened less closed), how (what ends its declaration), section
    (whether it starts one), kind and name (what it declares), member and owner (the class member or class that it
    would be within a class, or start).
    """
    before: dict | None = None
    depth, last = 0, 0
    indented, bracketed, section, classes = [], [], [], []

    def close(held: list, end: int):
        path, name, kind, line = held
        return path, name, kind, line, max(end, line)

    def rest():
        for _, held in indented + section:
            yield close(held, last)
        for _, held in bracketed:
            yield close(held, held[3])

    for row in lines:
        if before is None or row["path"] != before["path"] or row["line"] <= before["line"]:
            if before is not None:
                yield from rest()
            depth, last = 0, 0
            indented, bracketed, section, classes = [], [], [], []
        before = row
        if not row["blank"]:
            while indented and row["indent"] <= indented[-1][0]:
                yield close(indented.pop()[1], last)
        if row["section"]:
            while section:
                yield close(section.pop()[1], last)
        if not row["blank"]:
            last = row["line"]
        found = [(row["name"], row["kind"])] if row["name"] is not None else []
        if row["member"] is not None and classes and depth == classes[-1][0]:
            found.append((f"{classes[-1][1]}.{row['member']}", "method"))
        for name, kind in found:
            held = [row["path"], name, kind, row["line"]]
            if row["how"] == "indent":
                indented.append((row["indent"], held))
            elif row["how"] == "section":
                section.append((0, held))
            elif row["how"] == "bracket":
                bracketed.append((depth, held))
            else:
                yield close(held, row["line"])
        depth += row["step"]
        while bracketed and depth <= bracketed[-1][0]:
            yield close(bracketed.pop()[1], row["line"])
        while classes and depth < classes[-1][0]:
            classes.pop()
        if row["owner"] is not None and row["step"] > 0:
            classes.append((depth, row["owner"]))
    if before is not None:
        yield from rest()


def declared_bodies(lines: DataFrame) -> DataFrame:
    """bodies over a table whose rows of one path come in order in one partition, as an explode of files makes them."""

    def rows(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches):
        held = []
        for found in bodies(rows(batches)):
            held.append(found)
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        yield _batch(held)

    return lines.select("path", "line", "blank", "indent", "step", "how", "section", "kind", "name", "member", "owner").mapInArrow(
        run, "path string, name string, kind string, line int, end_line int"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
