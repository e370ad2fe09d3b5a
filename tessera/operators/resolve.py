"""Import specifiers to files: every candidate a specifier may mean, joined with the paths there are."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Suffixes that a specifier may leave out, in the order they are tried.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".gd", ".tscn", ".tres")
_KIND = ArrayType(StructType().add("key", StringType()).add("value", StringType()).add("rank", IntegerType()))


def _module(stem: str, names=("index", "__init__")) -> list[str]:
    return [stem, *(stem + s for s in SUFFIXES), *(posixpath.join(stem, n + s) for n in names for s in SUFFIXES)]


def candidates_of(path: str, spec: str, language: str) -> list[tuple[str, str]]:
    """What a specifier may mean, best first: ("path", a path), ("dir", a folder of Go files), ("stem", a module
    name anywhere) or ("class", a global class name)."""
    here = posixpath.dirname(path)
    exact = lambda found: [("path", posixpath.normpath(f)) for f in found]
    if spec.startswith("res://"):
        return exact([spec[6:]])
    if language in ("js", "gd") and spec.startswith("."):
        return exact(_module(posixpath.normpath(posixpath.join(here, spec))))
    if language == "py":
        dots = len(spec) - len(spec.lstrip("."))
        parts = [p for p in spec[dots:].split(".") if p]
        if not parts:
            return []
        base = posixpath.join(here, *[".."] * (dots - 1)) if dots else ""
        stem = posixpath.join(base, *parts)
        return exact([stem + ".py", posixpath.join(stem, "__init__.py")])
    if language == "go":
        last = spec.rstrip("/").rsplit("/", 1)[-1]
        return [("dir", last), ("stem", last)] if last else []
    if language == "rs":
        clean = re.sub(r"::$", "", spec.split("{")[0].strip())
        parts = [p for p in clean.split("::") if p and p != "*"]
        if not parts:
            return []
        if parts[0] in ("crate", "self", "super"):
            ups = sum(p == "super" for p in parts)
            rest = [p for p in parts if p not in ("crate", "self", "super")]
            if not rest:
                return []
            roots = ["", "src"] if parts[0] == "crate" else [posixpath.join(here, *[".."] * max(0, ups - (posixpath.basename(path) != "mod.rs")))]
            found = []
            for n in range(len(rest), 0, -1):  # the last segments may be names inside the module
                found += [posixpath.join(root, *rest[:n]) + end for root in roots for end in (".rs", "/mod.rs")]
            return exact(found)
        return [("stem", parts[0])]
    return [("path", spec), *([("class", spec)] if language == "gd" else [])]


@F.pandas_udf(_KIND)
def _candidates(path: pd.Series, spec: pd.Series, language: pd.Series) -> pd.Series:
    rows = zip(path, spec, language, strict=True)
    return pd.Series([[{"key": k, "value": v, "rank": i} for i, (k, v) in enumerate(candidates_of(*r))] for r in rows], dtype=object)


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) for every import that names one file; a tie of the best candidates names none."""
    wanted = (
        imports.join(files.select("path", "language"), "path")
        .select("path", "spec", F.explode(_candidates("path", "spec", "language")).alias("c"))
        .select("path", "spec", "c.key", "c.value", "c.rank")
    )
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    stem = F.when(name.isin("__init__.py", "mod.rs"), folder).otherwise(F.regexp_replace(name, r"\.\w+$", ""))
    known = F.array(
        F.struct(F.lit("path").alias("key"), F.col("path").alias("value")),
        F.struct(F.lit("stem").alias("key"), stem.alias("value")),
        F.struct(F.lit("dir").alias("key"), F.when(F.endswith("path", F.lit(".go")), folder).alias("value")),
    )
    there = files.select(F.col("path").alias("dst"), F.explode(known).alias("k")).select("dst", "k.key", "k.value").where("value is not null")
    classes = files.where("class_name is not null").groupBy(F.col("class_name").alias("value")).agg(F.min("path").alias("dst"))
    there = there.unionByName(classes.select("dst", F.lit("class").alias("key"), "value"))
    # what several files share names none of them, however many they are
    named = there.groupBy("key", "value").agg(F.min("dst").alias("file"), (F.min("dst") != F.max("dst")).alias("shared"))
    hits = wanted.join(named, ["key", "value"])
    best = hits.groupBy("path", "spec").agg(F.min_by(F.struct("file", "shared"), "rank").alias("best"))
    return best.where("not best.shared").select(F.col("path").alias("src"), F.col("best.file").alias("dst"))
