"""Source trees as DataFrames: a listing with contents, what is left out, and how much of a tree is covered."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that are never read.
EXCLUDES = (
    "node_modules", ".git", "dist", "build", "out", "target", "vendor", ".venv", "venv", "__pycache__",
    ".next", ".nuxt", ".cache", "coverage", ".idea", ".vscode",
)
#: Suffixes and their languages. The suffix is case-sensitive.
LANGUAGES = {
    "js": (".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx"),
    "py": (".py",),
    "go": (".go",),
    "rs": (".rs",),
    "gd": (".gd",),
    "gdres": (".tscn", ".tres"),
    "json": (".json",),
}
MAX_FILE_BYTES, MAX_DEPTH, NAMED_SUFFIXES = 512 * 1024, 24, 24


def suffix(path: Column) -> Column:
    """The last dot and what follows in the file's name, '' without one; a leading dot is no suffix."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def language(path: Column) -> Column:
    ext = suffix(path)
    found = F.lit(None).cast("string")
    for name, suffixes in LANGUAGES.items():
        found = F.when(ext.isin(*suffixes), name).otherwise(found)
    return found


def ignored_names(text: str) -> tuple[set[str], set[str]]:
    """Bare names and *suffix endings of an ignore file; negations, slashes and other globs are not read."""
    names, endings = set(), set()
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#!":
            continue
        line = line.removesuffix("/")
        if "/" in line:
            continue
        if line.startswith("*") and "*" not in line[1:] and len(line) > 1:
            endings.add(line[1:])
        elif "*" not in line and "?" not in line and "[" not in line:
            names.add(line)
    return names, endings


def left_out(path: Column, excludes=EXCLUDES, names=(), endings=()) -> Column:
    """Paths under an excluded, ignored or dot directory, of an ignored name, or too deep. Dot files stay."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    found = F.exists(folders, lambda p: F.startswith(p, F.lit(".")) | p.isin(*excludes)) | (F.size(parts) > MAX_DEPTH + 1)
    if names:
        found = found | F.exists(parts, lambda p: p.isin(*names))
    for ending in endings:
        found = found | _any_ends(parts, ending)
    return found


def _any_ends(parts: Column, ending: str) -> Column:
    return F.exists(parts, lambda p: F.endswith(p, F.lit(ending)))


def _told(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    prefix = _prefix(spark, root)
    # a file that is read by its own path comes back as such
    return rows.select(
        F.substring("path", len(prefix) + 1, 1 << 30).alias("path"),
        F.col("length").alias("bytes"),
        (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"),
        "content",
    )


def stat(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, bytes, mtime_ms) of every file below root. No file is opened: the content is not asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _told(spark, rows, root).drop("content")


def _decoded(rows: DataFrame) -> DataFrame:
    # the source filters by length before it opens a file, and does not open what nobody reads the content of
    text = F.decode("content", "UTF-8")
    small = rows.where(F.col("bytes") <= MAX_FILE_BYTES).withColumn("content", F.when(~F.contains(text, F.lit("\0")), text))
    large = rows.where(F.col("bytes") > MAX_FILE_BYTES).withColumn("content", F.lit(None).cast("string"))
    return small.unionByName(large).withColumn("readable", F.col("content").isNotNull())


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, bytes, mtime_ms, content, readable) of every file below root.

    Files over the size limit and binary ones (with a NUL byte) are not readable and have no content.
    """
    return _decoded(_told(spark, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root))


#: So many changed files are named to the source; if more changed, the tree is read and the others are left out.
NAMED_FILES = 10_000


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """scan, of some paths only."""
    named = [r.path for r in paths.select("path").limit(NAMED_FILES + 1).collect()]
    if len(named) > NAMED_FILES:
        return scan(spark, root).join(paths.select("path"), "path", "left_semi")
    if not named:
        return scan(spark, root).limit(0)
    prefix = _prefix(spark, root)
    # characters that a path pattern would take for its own
    whole = [prefix + re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in named]
    return _decoded(_told(spark, spark.read.format("binaryFile").load(whole), root))


def capped_text(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text, bytes, truncated) of the files at a path: their first max_bytes bytes as text."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(
        "path",
        F.decode(F.substring("content", 1, max_bytes), "UTF-8").alias("text"),
        F.col("length").alias("bytes"),
        (F.col("length") > max_bytes).alias("truncated"),
    )


def _prefix(spark: SparkSession, root: str) -> str:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString().rstrip("/") + "/"


def from_map(spark: SparkSession, contents: dict[str, str], mtime_ms: float = 0.0) -> DataFrame:
    """A listing from given texts, for small trees."""
    rows = [(p, len(t.encode()), mtime_ms, t, True) for p, t in contents.items()]
    return spark.createDataFrame(rows, "path string, bytes long, mtime_ms double, content string, readable boolean")


def candidates(listing: DataFrame, excludes=EXCLUDES, ignore: str = "") -> DataFrame:
    """The files that are indexed, with their language."""
    return known(listing, excludes, ignore).where("language is not null and readable")


def known(listing: DataFrame, excludes=EXCLUDES, ignore: str = "") -> DataFrame:
    """The files that are not left out, with their language, if they have one that is indexed."""
    names, endings = ignored_names(ignore)
    return listing.where(~left_out(F.col("path"), (*EXCLUDES, *excludes), names, endings)).withColumn("language", language(F.col("path")))


def coverage(listing: DataFrame, excludes=EXCLUDES, ignore: str = "") -> DataFrame:
    """One row: files seen, candidates, failed and skipped, and the most frequent suffixes skipped."""
    kept = known(listing, excludes, ignore)
    skipped = F.col("language").isNull()
    totals = kept.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~skipped & F.col("readable")).alias("candidates"),
        F.count_if(~skipped & ~F.col("readable")).alias("failed"),
        F.count_if(skipped).alias("skipped"),
    )
    named = (
        kept.where(skipped)
        .groupBy(suffix(F.col("path")).alias("suffix"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "suffix")
        .limit(NAMED_SUFFIXES)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "suffix", "n"))).alias("found"))
        .select(F.transform("found", lambda x: F.struct(x["suffix"].alias("suffix"), x["n"].alias("n"))).alias("suffixes"))
    )
    return totals.crossJoin(named)  # one row each


def project_root(start: str, marker: str) -> str:
    """The nearest folder from start up that holds the marker, else a git folder, else start."""
    for name in (marker, ".git"):
        at = os.path.abspath(start)
        while True:
            if os.path.isdir(os.path.join(at, name)):
                return at
            above = os.path.dirname(at)
            if above == at:
                break
            at = above
    return os.path.abspath(start)


def inside(folder: str, relative: str) -> str | None:
    """The path below the folder, or None if it leads out of it."""
    found = os.path.normpath(os.path.join(folder, relative))
    return found if found == folder or found.startswith(folder.rstrip("/") + "/") else None
