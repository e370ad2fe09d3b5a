"""Mixing documents to target weights with soft domain membership.

A naive Bayes classifier over hashed byte trigrams, trained from a labelled table, gives every document its
posterior over the domains. Nonnegative rates for all documents are then fitted by projected gradient least
squares, so that the expected tokens of each domain (sum of rate * tokens * posterior) meet the targets.
Each step needs a sum of one number per domain over all documents, and a document's rate follows from its
posterior and the steps so far, so that rates are column expressions and nothing of a document is collected.
Steps go on until they do not come nearer to the targets; what is missed then is returned with the rates.

A token is a run of bytes other than white space here: the classifier reads every byte anyway, and the targets
are shares.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, map_arrow, map_pandas, stage
from tessera.llm.shingles import SLICE_BYTES, text_slices

BUCKETS = 1 << 13
#: At most about so many labelled documents are learned from, chosen by a hash of their text.
MAX_TRAINING_DOCS = 5_000
#: A text counts for at most so many independent trigrams, so that long texts keep soft posteriors.
EVIDENCE = 10.0
#: So many steps are held as one expression; then the rates are written and the search goes on from them.
STEPS_HELD = 8
#: A step is of use if it takes this part off what is missed (times the part of the step that is taken).
LEAST_GAIN = 1e-3
#: The default domains and their shares of all tokens.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}
TOLERANCE = 1e-9
#: Where every row must stay, rates do not fall under this bound; it is halved until the shares are met.
FLOOR = 0.25
#: A domain's share of the tokens is met when it is off by no more than this.
MET = 1e-3
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each place on."""
    x = data.astype(np.uint32)
    x = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) & np.uint32(0xFFFFFFFF)
    return (x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS)


def train(labelled: DataFrame, domains: list[str], text_col: str = "text", domain_col: str = "domain", max_docs: int = MAX_TRAINING_DOCS) -> np.ndarray:
    """Log-probabilities, domains x BUCKETS, with the log prior as the last column.

    Rows with a null text or a domain not listed are left out.
    """
    known = labelled.where(F.col(domain_col).isin(domains) & F.col(text_col).isNotNull())
    share = min(1.0, max_docs / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        F.col(domain_col).alias("domain"), F.col(text_col).alias("text")
    )

    def count(batches: Iterable[pd.DataFrame]):
        counts = np.zeros((len(domains), BUCKETS + 1), dtype=np.int64)
        for pdf in batches:
            for domain, text in zip(pdf["domain"], pdf["text"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                k = domains.index(domain)
                counts[k, BUCKETS] += 1
                if len(data) > 2:
                    counts[k, :BUCKETS] += np.bincount(_trigrams(data), minlength=BUCKETS)
        k, bucket = np.nonzero(counts)
        yield pd.DataFrame({"k": k, "bucket": bucket, "n": counts[k, bucket]})

    found = np.zeros((len(domains), BUCKETS + 1))
    # at most domains x (BUCKETS + 1) rows
    for r in sample.transform(map_pandas, count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect():
        found[r.k, r.bucket] = r.n
    grams, seen = found[:, :BUCKETS] + 0.5, found[:, BUCKETS:] + 1.0
    return np.log(np.concatenate([grams / grams.sum(axis=1, keepdims=True), seen / seen.sum()], axis=1))


def _long(data: np.ndarray, table: np.ndarray, most: int = SLICE_BYTES) -> tuple[int, np.ndarray, int]:
    """Tokens, sums of the trigrams' log-probabilities and number of trigrams of one text, a bounded part at a time."""
    tokens, before, counts = 0, False, np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(data), most):
        part = data[start : start + most + 2]
        if len(part) > 2:
            counts += np.bincount(_trigrams(part), minlength=BUCKETS)
        inside = ~_SPACE[part[:most]]
        tokens += int(inside[0] and not before) + int((inside[1:] & ~inside[:-1]).sum())
        before = bool(inside[-1])
    return tokens, counts @ table, int(counts.sum())


def _describe(texts: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whitespace-separated tokens and the domains' posterior of each text."""
    tokens, scores = [], []
    table = np.ascontiguousarray(model[:, :BUCKETS].T)
    for _, offsets, data in text_slices(texts):
        if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
            held, total, n = _long(data, table)
            tokens.append(np.array([held]))
            scores.append(model[None, :, BUCKETS] + total[None, :] / n * min(n, EVIDENCE))
            continue
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        begins[starts] = inside[starts]
        counted = np.concatenate([[0], np.cumsum(begins)])
        tokens.append(counted[offsets[1:]] - counted[offsets[:-1]])
        rows = len(offsets) - 1
        score = np.tile(model[:, BUCKETS], (rows, 1))
        if len(data) > 2:
            gram = _trigrams(data)
            stop = np.maximum(offsets[1:] - 2, offsets[:-1])  # trigrams that lie within the text
            for k in range(model.shape[0]):
                total = np.concatenate([[0.0], np.cumsum(table[gram, k])])
                total = np.concatenate([total, np.full(2, total[-1])])
                n = stop - offsets[:-1]
                mean = (total[stop] - total[offsets[:-1]]) / np.maximum(1, n)
                score[:, k] += np.where(n > 0, mean * np.minimum(n, EVIDENCE), 0.0)
        scores.append(score)
    score = np.concatenate(scores)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return np.concatenate(tokens), p / p.sum(axis=1, keepdims=True)


def with_posteriors(docs: DataFrame, model: np.ndarray, text_col: str = "text", tokens_as: str = "__tokens", posterior_as: str = "__p") -> DataFrame:
    """docs with two more columns: tokens (long) and posterior (array of double). Null texts are empty."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(tokens_as, T.LongType()), T.StructField(posterior_as, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, p = _describe(batch.column(batch.schema.get_field_index(text_col)), model)
            listed = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), listed], names=[*batch.schema.names, tokens_as, posterior_as])

    return docs.transform(map_arrow, run, schema)


def rate(steps: list[np.ndarray], posterior: str, floor: float = 0.0, start: Column | None = None) -> Column:
    """A document's rate after the steps: each takes off posterior * step, and stops at the floor."""
    r = F.lit(1.0) if start is None else start
    for step in steps:
        off = sum((F.get(F.col(posterior), k) * float(v) for k, v in enumerate(step)), F.lit(0.0))
        r = F.greatest(F.lit(floor), r - off)
    return r


@dataclass
class Fit:
    """The rows with their rates in column, and how near the targets they come.

    shares: the domains' parts of the tokens that the rates give; miss: by how much of all tokens a total is off
    its target at most; lowest: the smallest rate.
    """

    rated: DataFrame
    column: str
    shares: np.ndarray
    miss: float
    lowest: float
    steps: int


def fit(described: DataFrame, weights: list[float], tokens: str = "__tokens", posterior: str = "__p", floor: float = 0.0) -> Fit:
    """Projected gradient search from rates of 1, over rates of floor or more.

    It minimises the distance of the expected domain totals A r from the targets b (weights, normalised,
    times all tokens). Each rate's step is divided by its tokens, and the gradient is scaled by the inverse
    of the sum of tokens * p p' over the documents with a rate above the floor; a step that does not come nearer to
    the targets is halved. Where no part of such a step does, since the floor holds too many rates, the sum over
    all documents scales the steps, and after that plain gradient steps follow, of the length that always comes
    nearer or a longer one. Every step needs one row of sums over
    all documents. It ends when the targets are met to TOLERANCE, or when no step of the three kinds gains
    LEAST_GAIN of what is missed. Targets that no such rates reach are met as
    nearly as possible; without tokens every rate is 1.
    """
    k = len(weights)
    t = F.col(tokens)
    p = [F.get(F.col(posterior), i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    (column,) = fresh(described.columns, "rate")
    rows, start, steps, done = described, None, [], 0

    def sums(steps):
        r = rate(steps, posterior, floor, start)
        free = F.when(r > floor, t).otherwise(0)
        row = rows.agg(
            F.sum(t).alias("n"),
            F.min(r).alias("low"),
            F.sum(t * r).alias("all"),
            *[F.sum(t * r * p[i]).alias(f"a{i}") for i in range(k)],
            *[F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs],
        ).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
        return float(row.n or 0), np.array([float(row[f"a{i}"] or 0) for i in range(k)]), gram, row

    total, got, gram, row = sums([])
    share = np.array(weights) / sum(weights)
    everything, failed = gram, 0
    part, kind = 1.0, 0
    while total:
        residual = got - share * total
        if np.abs(residual).max() <= TOLERANCE * total:
            break
        if kind < 2:
            scale = np.linalg.pinv((gram if kind == 0 else everything) + 1e-9 * total * np.eye(k))
        else:
            scale = np.eye(k) / np.linalg.norm(everything, 2)
        step = part * (scale @ residual)
        _, next_got, next_gram, next_row = sums([*steps, step])
        gain = 1 - np.linalg.norm(next_got - share * total) / np.linalg.norm(residual)
        if gain > LEAST_GAIN * part:
            steps.append(step)
            got, gram, row, done, failed = next_got, next_gram, next_row, done + 1, 0
            part = min(1.0, 2 * part) if kind < 2 else 2 * part
        elif part > (0.02 if kind < 2 else 1):
            part /= 2
        else:
            part, kind, failed = 1.0, (kind + 1) % 3, failed + 1
            if failed == 3:
                break
        if len(steps) == STEPS_HELD:
            rows = stage(rows.withColumn(column, rate(steps, posterior, floor, start)), "rates")
            start, steps = F.col(column), []
    rated = rows.withColumn(column, rate(steps, posterior, floor, start))
    if not total:
        return Fit(rated, column, share, 0.0, 1.0, 0)
    shares = got / float(row["all"]) if row["all"] else 0 * share
    return Fit(rated, column, shares, float(np.abs(got / total - share).max()), float(row.low), done)


def rates(docs: DataFrame, model: np.ndarray, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, posterior (in the order of targets), rate, and in all rows alike miss: by how
    much of all tokens a domain's expected total is off its target at most.

    Null and empty texts have no tokens and the prior as their posterior; repeated rows have a rate each; an
    empty table gives an empty result; other columns are not read. A text of any length is read in bounded parts.
    Targets that no nonnegative rates reach are met as nearly as possible.
    """
    light = stage(
        with_posteriors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).drop("text"), "posteriors"
    )
    found = fit(light, list(targets.values()))
    return found.rated.select(
        "doc_id", F.col("__tokens").alias("n_tokens"), F.col("__p").alias("posterior"), "rate", F.lit(found.miss).alias("miss")
    )


def fit_whole(described: DataFrame, weights: list[float], tokens: str = "__tokens", posterior: str = "__p") -> Fit:
    """A fit whose shares of all tokens meet the weights when every rate is divided by the smallest.

    The fit is held above a floor, as a document of rate r comes r / smallest times. The floor is halved while
    shares are missed by more than MET and the miss still falls by a tenth: at weights that cannot be met (of a
    domain without documents, say) the larger floor stays.
    """
    share = np.array(weights) / sum(weights)
    floor, best, chosen = FLOOR, np.inf, None
    while True:
        found = fit(described, weights, tokens, posterior, floor)
        miss = float(np.abs(found.shares - share).max())
        if chosen is not None and miss > 0.9 * best:
            return chosen
        best, chosen = miss, found
        if miss <= MET:
            return chosen
        floor /= 2


def repeat_to_targets(docs: DataFrame, model: np.ndarray, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its rate says, so that the domains' tokens come to the targets.

    Rates are scaled so that the smallest is 1: no document is lost, those of domains that are short of
    their target are repeated. A domain that holds s of the tokens against a target of w makes the result
    s / w times as large at least, and more where memberships are soft. The fraction of a rate becomes one
    more copy for that share of documents, chosen by a hash of id and text. Nulls, empty texts, repeated rows
    and empty tables go as in rates; columns are kept whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tokens, p, chance = fresh(docs.columns, "tokens", "posterior", "chance")
    described = stage(with_posteriors(docs, model, text_col, tokens, p), "posteriors")
    found = fit_whole(described, list(targets.values()), tokens, p)
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.greatest(F.lit(1), F.floor(F.col(found.column) / found.lowest + drawn).cast("int"))
    return found.rated.select(F.explode(F.sequence(F.lit(1), copies)).alias(chance), *columns).select(*columns)


def labelled_languages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_docs: int = MAX_TRAINING_DOCS) -> DataFrame:
    """text and domain (lang) of at most about max_docs documents that the labels table holds."""
    told = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct()
    share = min(1.0, max_docs / max(1, told.count()))
    chosen = told.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select(F.col(id_col).alias("__doc"), "text", F.col("lang").alias("domain")).join(
        F.broadcast(chosen), F.col("__doc") == F.col("__id"), "left_semi"  # bounded by max_docs
    )
    return stage(found.select("text", "domain"), "labelled")
