"""A positional inverted index over bodies: for each word and path the places where the word stands.

Words are those of functions.text.search_form: lower case without accents, each CJK character a word. Rows are
dealt by ranges of (bucket of the word, word, path), so that a frequent word spreads over tasks and files, and are
written in folders by bucket; a query reads the folders of its words only, and in them, by Parquet's statistics and
bloom filters, their row groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import bounded_batches

BUCKETS = 64
#: So many paths are named to the scan that fetches their bodies; more are joined.
FEW = 1000
#: Postings of an Arrow batch that goes back to Spark.
ROWS = 1 << 16


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def placed(batches):
    """Batches of (term, path, places) of batches of (path, form), of ROWS rows at most each.

    Words stay in Arrow and numpy as codes and places; a list a word of Python numbers would take many times the text.
    """
    for batch in batches:
        paths = batch.column(0)
        # null forms have no list, empty ones a list of an empty word
        lists = pc.split_pattern(pc.ascii_trim(batch.column(1), " "), " ")
        words, rows = lists.flatten(), pc.list_parent_indices(lists)
        held = pc.not_equal(words, "")
        words, rows = words.filter(held).dictionary_encode(), rows.filter(held).to_numpy().astype(np.int64)
        if not len(rows):
            continue
        codes, terms = words.indices.to_numpy(), words.dictionary
        counts = np.bincount(rows)
        places = (np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]).astype(np.int32)
        keys = rows * len(terms) + codes
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        starts = np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys))
        for at in range(0, len(starts) - 1, ROWS):
            bounds = starts[at : at + ROWS + 1]
            row, code = np.divmod(keys[bounds[:-1]], len(terms))
            columns = [
                terms.take(pa.array(code)).cast(pa.string()),
                paths.take(pa.array(row)).cast(pa.string()),
                pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(places[bounds[0] : bounds[-1]])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "path", "places"])


def postings(docs: DataFrame) -> DataFrame:
    """(bucket, term, path, places): where each word of a body (path, body) stands, from 0."""
    bounded_batches(docs.sparkSession)
    forms = docs.select("path", T.search_form(T.pad_cjk(F.col("body"))).alias("form"))
    found = forms.mapInArrow(placed, "term string, path string, places array<int>")
    return found.select(bucket_of(F.col("term")).alias("bucket"), "term", "path", "places")


@dataclass
class Wanted:
    """A query's phrases as words, and the buckets of its words."""

    phrases: list[list[str]]
    buckets: list[int]

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for t in p})


def wanted(spark: SparkSession, q: str) -> Wanted:
    """The phrases of a query: each of its words, as the index would split it."""
    asked = T.query_words(q)
    if not asked:
        return Wanted([], [])
    forms = spark.range(1).select(F.array(*[T.search_form(T.pad_cjk(F.lit(w))) for w in asked])).first()[0]
    phrases = [f.split() for f in forms]
    terms = sorted({t for p in phrases for t in p})
    buckets = spark.range(1).select(F.array(*[bucket_of(F.lit(t)) for t in terms])).first()[0] if terms else []
    return Wanted(phrases, sorted(set(buckets)))


def matching(index: DataFrame, query: Wanted) -> DataFrame:
    """The paths whose bodies hold every phrase of the query; none, if a phrase has no word."""
    if not query.phrases or not all(query.phrases):
        return index.select("path").limit(0)
    held = index.where(F.col("bucket").isin(query.buckets) & F.col("term").isin(query.terms))
    if len(query.terms) == 1 and all(len(p) == 1 for p in query.phrases):
        return held.select("path")
    # one row a path and term of the query
    by_path = held.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    found = F.size("at") == len(query.terms)
    for phrase in query.phrases:
        places = F.col("at")[phrase[0]]
        for term in phrase[1:]:
            places = F.array_intersect(F.transform(places, lambda x: x + 1), F.col("at")[term])
        if len(phrase) > 1:
            found = found & (F.size(places) > 0)
    return by_path.where(found).select("path")


def bodies_of(docs: DataFrame, paths: DataFrame, told: Callable[[DataFrame], DataFrame] = lambda bodies: bodies) -> DataFrame:
    """The rows of docs of some paths: named to the scan, where Parquet can skip by them, if they are few.

    told: what is asked of each row, with its path; of many rows it is told before they are joined, so that bodies are
    not shuffled.
    """
    few = [r.path for r in paths.select("path").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return told(docs.where(F.col("path").isin(few)) if few else docs.limit(0))
    return told(docs).join(paths.select("path").distinct(), "path", "left_semi")
