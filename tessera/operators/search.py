"""Ranked search over symbols, paths and bodies, maps of a project, and answers cut to a token budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import text_index
from tessera.sources.staging import written

SYMBOL_LIMIT, TEXT_LIMIT, PER_FILE = 60, 6, 1
FIND_BUDGET, MAP_BUDGET = 2000, 1200


def symbol_matches(symbols: DataFrame, files: DataFrame, q: str, per_file: int = PER_FILE, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """Symbols whose name holds the query, the best per_file of each file: tier, then line."""
    best = Window.partitionBy("path").orderBy(F.desc("tier"), "line", "name")
    return (
        symbols.withColumn("tier", T.match_tier(F.col("name"), q))
        .where("tier is not null")
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= per_file)
        .drop("nth")
        .join(files.select("path", "importance"), "path")
        .orderBy(F.desc("tier"), F.desc("importance"), "path", "line", "name")
        .limit(limit)
    )


def path_matches(files: DataFrame, q: str, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """Files whose path, or else description, holds the query."""
    tier = F.when(T.contains_ci(F.col("path"), q), T.PATH).when(T.contains_ci(F.col("description"), q), T.DESCRIPTION)
    return (
        files.select("path", "importance", tier.alias("tier"))
        .where("tier is not null")
        .orderBy(F.desc("tier"), F.desc("importance"), "path")
        .limit(limit)
    )


def text_matches(docs: DataFrame, files: DataFrame, q: str, limit: int = TEXT_LIMIT, postings: DataFrame | None = None) -> DataFrame:
    """Bodies that hold every word of the query as a whole word (a phrase, if it has punctuation) and as it is
    written: weight, line of the first word, and an excerpt.

    A query that is one identifier must not be part of a longer one. Places and weights are ranked without the
    bodies; those of the answers are fetched afterwards. postings: an index of the bodies (see text_index), which says
    in which of them the whole words are; without it all bodies are searched, by the cheapest test first.
    """
    body = F.col("body")

    def told(bodies):
        bodies = bodies.where(T.holds_words(body, q))
        if postings is None:
            bodies = bodies.where(T.matches_phrases(body, q))
        if T.identifier_shaped(q):
            bodies = bodies.where(T.has_identifier(body, q))
        return bodies.select("path", T.every_word_at(body, q).alias("at"), T.body_weight(body, q).alias("weight")).where("at > 0")

    if postings is None:
        hits = told(docs)
    else:
        hits = text_index.bodies_of(docs, text_index.matching(postings, text_index.wanted(docs.sparkSession, q)), told)
    top = (
        hits.join(files.select("path", "importance"), "path")
        .orderBy(F.desc("weight"), F.desc("importance"), "path")
        .limit(limit)
    )
    if postings is not None:
        top = written(top)  # else it is found once more for the bodies
        docs = text_index.bodies_of(docs, top)
    # at most limit rows
    found = docs.select("path", "body").join(F.broadcast(top), "path").withColumn("line", T.line_at(body, F.col("at")))
    return found.select("path", "weight", "importance", "line", T.excerpt(body, F.col("line")).alias("excerpt")).orderBy(
        F.desc("weight"), F.desc("importance"), "path"
    )


def phrase_matches(docs: DataFrame, q: str) -> DataFrame:
    """Bodies that hold each whitespace word of the query as a phrase of whole words, case and accents aside."""
    return docs.where(T.matches_phrases(F.col("body"), q))


def find(
    symbols: DataFrame,
    files: DataFrame,
    docs: DataFrame,
    q: str,
    limit: int = SYMBOL_LIMIT,
    text_limit: int = TEXT_LIMIT,
    per_file: int = PER_FILE,
    postings: DataFrame | None = None,
) -> DataFrame:
    """One answer per file from the three sources, the best by tier, weight and importance."""
    if not q.strip():
        return files.select("path").limit(0).selectExpr(
            "path", "cast(null as string) name", "0 tier", "0L weight", "0D importance", "0L line", "'' source"
        )
    named = symbol_matches(symbols, files, q, per_file, limit).select(
        "path", "name", "tier", F.lit(0).cast("long").alias("weight"), "importance", F.col("line").cast("long").alias("line"), F.lit("symbol").alias("source")
    )
    none, zero = F.lit(None).cast("string").alias("name"), F.lit(0).cast("long")
    paths = path_matches(files, q, limit).select("path", none, "tier", zero.alias("weight"), "importance", zero.alias("line"), F.lit("path").alias("source"))
    texts = text_matches(docs, files, q, text_limit, postings).select("path", none, F.lit(T.TEXT).alias("tier"), "weight", "importance", "line", F.lit("text").alias("source"))
    order = F.when(F.col("source") == "symbol", 0).when(F.col("source") == "path", 1).otherwise(2)
    best = Window.partitionBy("path").orderBy(F.desc("tier"), F.desc("weight"), F.desc("importance"), order, "line", "name")
    return (
        named.unionByName(paths)
        .unionByName(texts)
        .withColumn("nth", F.row_number().over(best))
        .where("nth = 1")
        .drop("nth")
        .orderBy(F.desc("tier"), F.desc("weight"), F.desc("importance"), "path")
    )


def other_names(symbols: DataFrame, found: DataFrame, q: str) -> DataFrame:
    """The symbols of the best file of find's answer that match the query, the best first."""
    best = found.orderBy(F.desc("tier"), F.desc("weight"), F.desc("importance"), "path").limit(1).select("path")
    return (
        symbols.withColumn("tier", T.match_tier(F.col("name"), q))
        .where("tier is not null")
        .join(F.broadcast(best), "path")  # one row
        .orderBy(F.desc("tier"), "line", "name")
    )


def blended(symbols: DataFrame, files: DataFrame, q: str) -> DataFrame:
    """The older single score: tier + 10 * importance; a path counts without a symbol, a description without both."""
    named = (
        symbols.withColumn("tier", T.match_tier(F.col("name"), q)).where("tier is not null").groupBy("path").agg(F.max("tier").alias("named"))
    )
    tier = F.coalesce(
        F.col("named"),
        F.when(T.contains_ci(F.col("path"), q), T.PATH),
        F.when(T.contains_ci(F.col("description"), q), T.DESCRIPTION),
    )
    return (
        files.join(named, "path", "left")
        .select("path", (tier + F.col("importance") * 10).alias("score"))
        .where("score is not null")
        .orderBy(F.desc("score"), "path")
    )


def file_detail(files: DataFrame, rel: str) -> DataFrame:
    """The file of that path, else the first whose path ends in it."""
    rel = re.sub(r"^(\./)+", "", rel)
    ends = F.endswith(T.ascii_lower(F.col("path")), T.ascii_lower(F.lit(rel)))
    return files.where(ends).orderBy((F.col("path") != rel).cast("int"), "path").limit(1)


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files, tokens and the most important file (ties: first path) by first path segment."""
    top = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    return (
        files.groupBy(top.alias("dir"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("tokens").alias("tokens"),
            F.min(F.struct((-F.col("importance")).alias("i"), F.col("path").alias("p"))).alias("best"),
        )
        .select("dir", "files", "tokens", F.col("best.p").alias("top_path"))
        .orderBy(F.desc("tokens"), "dir")
    )


def focus_terms(focus: str) -> list[str]:
    return [t for t in re.split(r"[\s,]+", focus.lower()) if len(t) >= 2]


def focused_map(files: DataFrame, symbols: DataFrame, focus: str) -> DataFrame:
    """Files scored by the focus terms in path, description and symbol names."""
    terms = focus_terms(focus)
    if not terms:
        return files.select("path", F.lit(0.0).alias("score"), F.lit(False).alias("named"), F.lit(False).alias("exact"), "tokens").limit(0)
    low = F.lower("name")
    per_symbol = sum((F.when(low == t, 40).when(F.contains(low, F.lit(t)), 15).otherwise(0) for t in terms), F.lit(0))
    named = (
        symbols.select("path", per_symbol.alias("points"), F.array_contains(F.array(*map(F.lit, terms)), low).alias("exact"))
        .where("points > 0")
        .groupBy("path")
        .agg(F.sum("points").alias("points"), F.bool_or("exact").alias("exact"))
    )
    own = sum(
        (
            F.when(F.contains(F.lower("path"), F.lit(t)), 20).otherwise(0)
            + F.when(F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(t)), 8).otherwise(0)
            for t in terms
        ),
        F.lit(0),
    )
    points = own + F.coalesce("points", F.lit(0))
    return (
        files.join(named, "path", "left")
        .select(
            "path",
            points.alias("points"),
            (points + F.col("importance") * 12).alias("score"),
            F.col("exact").isNotNull().alias("named"),
            F.coalesce("exact", F.lit(False)).alias("exact"),
            "tokens",
        )
        .where("points > 0")
        .drop("points")
        .orderBy(F.desc("exact"), F.desc("named"), F.desc("score"), "path")
    )


def within_budget(rows: DataFrame, order: list, cost: Column, budget: int, least_cost: int = 6) -> DataFrame:
    """The longest prefix in order whose running cost stays within the budget; the first row always stays.

    No more rows than budget / least_cost can fit, which bounds what the running sum sees.
    """
    ranked = Window.orderBy(*order)
    return (
        rows.withColumn("cost", cost)
        .orderBy(*order)
        .limit(budget // least_cost + 2)
        .withColumn("running", F.sum("cost").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(ranked))
        .where((F.col("running") <= budget) | (F.col("nth") == 1))
        .drop("nth")
    )


def symbol_bodies(symbols: DataFrame, docs: DataFrame, most: int = 80) -> DataFrame:
    """The stored lines of each symbol, at most so many, and how many were left out."""
    shown, omitted = T.body_slice(F.col("body"), F.col("line"), F.col("end_line"), most)
    return symbols.join(docs.select("path", "body"), "path").select(
        *symbols.columns, shown.alias("shown"), omitted.alias("omitted")
    )


def index_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, symbols, tokens."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).crossJoin(
        symbols.agg(F.count(F.lit(1)).alias("symbols"))  # one row each
    )


def nested_entries(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Files with their symbols (by line, name) and imports as arrays."""
    inner = F.struct("line", "name", "kind", "end_line")
    s = symbols.groupBy("path").agg(F.array_sort(F.collect_list(inner)).alias("symbols"))
    i = imports.groupBy("path").agg(F.array_sort(F.collect_list("spec")).alias("imports"))
    return files.join(s, "path", "left").join(i, "path", "left")
