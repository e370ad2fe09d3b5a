"""The memory files: a JSON-lines journal, a JSON bug log and a status page of Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema

NOTE_LIMIT, DECISION_LIMIT = 200, 400
SECTIONS = ("Now", "Next", "Open", "Avoid")


def checked_notes(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the journal that is not blank: the note, seq (its place in the file), and problem, which says why
    the line is no note: no JSON (a torn line, say), a field missing or of another type. Null is a note."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq")).where(F.trim("value") != "")
    loose = F.try_parse_json("value")
    parsed = F.from_json("value", schema.NOTES, {"mode": "PERMISSIVE"})
    kind = lambda c: F.schema_of_variant(F.try_variant_get(loose, f"$.{c}", "variant"))
    bad = [
        F.when(loose.isNull() | ~F.startswith(F.schema_of_variant(loose), F.lit("OBJECT")), "not a JSON object"),
        *[F.when(F.coalesce(kind(c), F.lit("VOID")) == "VOID", f"no {c}") for c in ("at", "text")],
        *[F.when(~F.coalesce(kind(c), F.lit("VOID")).isin("STRING", "VOID"), f"{c} is no text") for c in ("at", "session", "kind", "text")],
    ]
    return lines.select(parsed.alias("note"), "seq", F.coalesce(*bad).alias("problem"), "value").select("note.*", "seq", "problem", F.when(F.col("problem").isNotNull(), F.col("value")).alias("line"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """The journal's notes; lines that are none are left out (see checked_notes). seq is the place in the file."""
    return checked_notes(spark, path).where("problem is null").drop("problem", "line")


def latest(notes: DataFrame, n: int) -> DataFrame:
    """The newest n notes, newest first."""
    return notes.orderBy(F.desc("at"), F.desc("seq")).limit(n)


def append_notes(notes: DataFrame, path: str) -> None:
    """Adds notes as JSON lines; those over the length limit of their kind are refused before anything is written."""
    most = F.when(F.col("kind") == "decision", DECISION_LIMIT).otherwise(NOTE_LIMIT)
    if notes.where(F.length("text") > most).limit(1).count():
        raise ValueError(f"a note is at most {NOTE_LIMIT} characters, a decision {DECISION_LIMIT}")
    notes.select("at", "session", "kind", "text").write.mode("append").json(path)


LOG_BYTES = 8 << 20


def checked_bugs(spark: SparkSession, path: str, most: int = LOG_BYTES) -> DataFrame:
    """One row a bug of the logs at a path, and one with a problem for a log that is too large or is no log, or for an
    entry without an id or an error message. A log is {"version": ..., "bugs": [...]} or the bare array."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", F.decode("content", "UTF-8").alias("value"))
    bare = F.from_json("value", F.lit(f"array<{schema.BUGS.simpleString()}>"))
    wrapped = F.from_json("value", F.lit(f"struct<version:int,bugs:array<{schema.BUGS.simpleString()}>>"))["bugs"]
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit(""))
    array, held = F.startswith(shape, F.lit("ARRAY")), F.rlike(shape, F.lit(r"^OBJECT<.*\bbugs: ARRAY"))
    read = small.select("path", F.when(array, bare).when(held, wrapped).alias("found"), F.when(shape == "", "not JSON").when(~array & ~held, "no list of bugs").alias("broken"))
    none = F.lit(None).cast(schema.BUGS)
    rows = read.where("broken is null").select("path", F.explode("found").alias("bug"))
    missing = F.when(F.col("bug.id").isNull(), "no id").when(F.col("bug.error_message").isNull(), "no error message")
    told = rows.select("path", "bug", missing.alias("problem"))
    told = told.unionByName(read.where("broken is not null").select("path", none.alias("bug"), F.col("broken").alias("problem")))
    large = files.where(F.col("length") > most).select("path", none.alias("bug"), F.format_string("%s bytes, more than %s", F.format_number("length", 0), F.format_number(F.lit(most), 0)).alias("problem"))
    return told.unionByName(large).select("bug.*", "problem", "path")


def read_bugs(spark: SparkSession, path: str) -> DataFrame:
    """The bugs of a log. A log that is broken or too large raises BrokenLog: it must not pass for an empty one."""
    checked = checked_bugs(spark, path)
    wrong = checked.where("id is null and error_message is null and problem is not null").select("path", "problem").limit(1).collect()
    if wrong:
        raise BrokenLog(f"{wrong[0].path}: {wrong[0].problem}")
    return checked.where("problem is null").drop("problem", "path")


class BrokenLog(Exception):
    """The file is no bug log."""


def number_sections(lines: DataFrame, key: list[str], at: str, heading: Column) -> DataFrame:
    """lines with heading and section: how many headings of their document stand at or before them."""
    order = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").cast("int")).over(order))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(pages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, section, title, body): a page cut at its "## " headings; section 0 is what stands before the first."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    numbered = number_sections(lines, [key], "at", F.startswith("line", F.lit("## ")))
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("at", "line"))))
    return numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("heading"), F.trim(F.regexp_replace("line", "^## ", "")))).alias("title"),
        _stripped(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"),
    )


def patch(found: DataFrame, updates: dict[str, str], key: str = "path") -> DataFrame:
    """Sections with new bodies for the named titles; unknown titles come last, blank updates are ignored."""
    told = [(t, b) for t, b in updates.items() if b and b.strip()]
    if not told:
        return found
    new = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("new_title"), F.lit(b.strip()).alias("new_body")) for n, (t, b) in enumerate(told, 1)])
    wanted = found.groupBy(key).agg(F.max("section").alias("last")).select(key, "last", F.inline(new))
    same = F.lower("title") == F.lower("new_title")
    joined = found.join(wanted.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & same, "full_outer")
    return joined.select(
        F.coalesce(key, "_key").alias(key),
        F.coalesce("section", F.col("last") + F.col("n")).alias("section"),
        F.coalesce("title", "new_title").alias("title"),
        F.coalesce("new_body", "body").alias("body"),
    )


def render(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): sections put together again in order."""
    text = F.when(F.col("title").isNull(), F.col("body")).otherwise(
        _stripped(F.concat(F.lit("## "), "title", F.lit("\n"), F.coalesce("body", F.lit(""))))
    )
    ordered = F.array_sort(F.collect_list(F.struct("section", text.alias("text"))))
    return found.groupBy(key).agg(F.concat(F.array_join(F.filter(F.transform(ordered, lambda x: x["text"]), lambda x: x != ""), "\n\n"), F.lit("\n")).alias("text"))
