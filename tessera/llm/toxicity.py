"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is a signed log-odds (informative Dirichlet prior) of its features, the word itself, its
prefixes and its suffixes: the largest above zero, or the least where none is. DRIFT is taken off every token, so that clean text scores
below zero on average, as the extreme-value law needs. A linear-time scan finds every maximal segment of a
text. On the scale of Karlin and Altschul a segment of score S in n tokens is worth lambda * S - ln(K * n):
lambda solves E exp(lambda * score) = 1 over the tokens of clean training texts, K is the maximum-likelihood
estimate from their best segments. The evidence of a text adds up its significant segments by the law of the
sum of the r best (those of a normalised score above SIGNIFICANT), and a one-dimensional logistic fit turns it into a probability.

Which segments are significant is chosen in the fit, by a split inside the rows that may be learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, map_pandas, stage

#: At most about so many labelled documents are learned from, chosen by a hash of their id.
MAX_TRAINING_DOCS = 20_000
PRIOR = 20.0
#: A feature counts if its log-odds lie so many standard errors from zero.
MIN_Z = 3.0
#: And, above zero, if they are so large.
MIN_ODDS = 2.0
#: A model has at most so many features, those farthest from zero in standard errors; it is sent to every task.
MAX_FEATURES = 50_000
DRIFT = 0.5
#: The normalised score from which a segment is added to a better one: what a fit chooses from, and takes if it can't.
SIGNIFICANTS, SIGNIFICANT = (2.0, 3.0, 5.0, 8.0), 5.0
#: What compare compares by default.
DRIFTS = (0.5, 1.0, 1.5, 2.0)
AFFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
#: Remainders of crc32 of the id modulo 4: never learned from, and what settings are measured on.
HELD_OUT, INNER = 2, 3
#: Words whose score a task remembers, and the length up to which it does.
CACHED_WORDS = 100_000
CACHED_CHARS = 32
#: Token scores are counted in steps of 1 / STEPS where lambda is fitted.
STEPS = 100
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """weights: feature -> log-odds."""

    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    intercept: float = -3.0
    drift: float = DRIFT
    significant: float = SIGNIFICANT


def features(word: str) -> list[str]:
    """The word, and its prefixes and suffixes of AFFIXES characters."""
    n = len(word)
    found = [f"={word}"]
    for k in AFFIXES:
        if n > k:
            found.append(f"<{word[:k]}")
            found.append(f">{word[-k:]}")
    return found


class Scorer:
    """Token scores with a bounded cache of words."""

    def __init__(self, model: Model):
        self.weights, self.drift = model.weights, model.drift
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        """The features' largest log-odds, the least where none is above zero, 0 without any; less the drift."""
        found = [o for f in features(word) if (o := self.weights.get(f)) is not None]
        most = max(found, default=0.0)
        score = (most if most > 0 else min(found, default=0.0)) - self.drift
        if len(word) <= CACHED_CHARS and len(self.known) < CACHED_WORDS:
            self.known[word] = score
        return score

    def tokens(self, text: str) -> list[float]:
        return [s if (s := self.known.get(w)) is not None else self.word(w) for w in WORD.findall(text.lower())]

    def hits(self, text: str) -> tuple[int, list[tuple[int, float, float]]]:
        """The number of tokens, and of those above zero (index, sum of all scores before, sum with it)."""
        known, word, found, n, total = self.known, self.word, [], 0, 0.0
        for n, m in enumerate(WORD.finditer(text.lower()), 1):
            w = m[0]
            score = known.get(w)
            if score is None:
                score = word(w)
            if score > 0.0:
                found.append((n - 1, total, total + score))
            total += score
        return n, found


def segments(hits: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score), in linear time.

    A segment begins and ends at a token above zero; those between count by the sums that hits carry.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum with it
    for index, before, after in hits:
        first = index
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                found.append((first, index, before, after))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def normalised(raw: float, n_tokens: int, model: Model) -> float:
    """The extreme-value scale: above 0 a segment this good is not expected by chance in n tokens."""
    return model.scale * raw - math.log(model.k * max(1, n_tokens))


def evidence(scores: list[float], n_tokens: int, model: Model) -> float:
    """Minus the logarithm of the chance of the text's segments, between -20 and 40.

    The best segment counts as it is. The r best of those above model.significant together have the sum T of their normalised
    scores, and a chance of about exp(-T) T^(r-1) / (r! (r-1)!), times 2^r for the choice of r.
    """
    ranked = sorted((normalised(s, n_tokens, model) for s in scores), reverse=True)
    best = ranked[0] if ranked else normalised(0.0, n_tokens, model)
    total = 0.0
    for r, s in enumerate(ranked, 1):
        if s <= model.significant:
            break
        total += s
        if r > 1 and total > r:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return min(40.0, max(-20.0, best))


def probability(x: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.intercept))))


def held_out(id_col: Column, *remainders: int) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT (or one of remainders) modulo 4; a null id is not held out."""
    return F.coalesce((F.crc32(id_col.cast("string").cast("binary")) % 4).isin(*(remainders or (HELD_OUT,))), F.lit(False))


def _count_features(batches):
    """(feature, toxic documents, clean documents, and those of either that are inner) of parts of the bounded sample."""

    def told(seen):
        names = list(set().union(*seen.values()))
        n = {of: np.array([c[f] for f in names], dtype=np.int64) for of, c in seen.items()}
        both = {label: n[label, True] + n[label, False] for label in (1, 0)}
        return pd.DataFrame({"feature": names, "n1": both[1], "n0": both[0], "i1": n[1, True], "i0": n[0, True]})

    empty = lambda: {(label, inner): Counter() for label in (1, 0) for inner in (True, False)}
    seen = empty()
    for pdf in batches:
        for text, label, inner in zip(pdf["text"], pdf["toxic"], pdf["inner"], strict=True):
            words = set(WORD.findall((text or "").lower()))
            seen[int(bool(label)), bool(inner)].update({f for w in words for f in features(w)})
            if sum(map(len, seen.values())) > 200_000:
                yield told(seen)
                seen = empty()
    if any(seen.values()):
        yield told(seen)


def log_odds(n1: Column, n0: Column, d1: int, d0: int) -> tuple[Column, Column]:
    """Log-odds of a feature in n1 of d1 toxic and n0 of d0 clean documents, and their standard errors from zero.

    The Dirichlet prior of both classes is PRIOR documents dealt as the feature is in all of them, and 0.05.
    """
    prior = PRIOR * (n1 + n0) / (d1 + d0) + 0.05
    y1, y0 = n1 + prior, n0 + prior
    odds = F.log(y1 / (d1 + PRIOR + 0.1 - y1)) - F.log(y0 / (d0 + PRIOR + 0.1 - y0))
    return odds, odds / F.sqrt(1 / y1 + 1 / y0)


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): each id once, toxic if any row says so; rows with a null id or label are left out."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return told.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int) -> DataFrame:
    """(inner, text, toxic): about max_docs labelled texts outside the held-out quarter at most, as a written table."""
    told = _labelled(labels).where(~held_out(F.col("doc_id")))
    share = min(1.0, max_docs / max(1, told.count()))
    chosen = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(
        F.col("doc_id").alias("__id"), "toxic"
    )
    found = (
        docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))  # bounded by max_docs
        .select(held_out(F.col("__id"), INNER).alias("inner"), "text", "toxic")
    )
    return stage(found, "toxicity-sample")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = MAX_TRAINING_DOCS,
    drift: float = DRIFT,
    significant: float | None = None,
) -> Model:
    """Learns from at most about max_docs labelled rows outside the held-out quarter.

    significant, if not given, is the one of SIGNIFICANTS with the best F1 on the rows of remainder INNER by a model
    that learned from the other rows; then all rows are learned from.
    Rows with a null label or id are not learned from; a repeated id in labels counts as toxic if any row
    says so. Without toxic or without clean examples the model has no feature and scores every text alike.
    """
    sample = _sample(docs, labels, id_col, text_col, max_docs)
    counts = _counted(sample)
    weights = _weights(counts)
    if weights is None:
        return Model()
    if significant is None:
        seen = _compared(sample, counts, (drift,), SIGNIFICANTS)
        best = max(seen, key=lambda r: (f1(r[2], r[3]), r[1] == SIGNIFICANT), default=(drift, SIGNIFICANT))
        significant = best[1]
    model = Model(weights, drift=drift, significant=significant)
    segmented = _segmented(sample, model)
    found = _evidence(segmented, _scaled(model, segmented), (significant,)).toPandas()  # one row a training text
    model.slope, model.intercept = fit_logistic(np.array(found.x.tolist()).reshape(-1), found.toxic.to_numpy(dtype=float))
    return model


def f1(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def compare(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = MAX_TRAINING_DOCS,
    drifts: tuple[float, ...] = DRIFTS,
    significants: tuple[float, ...] = SIGNIFICANTS,
) -> list[tuple[float, float, float, float]]:
    """(drift, significant, precision, recall) of models for each pair of settings.

    The held-out quarter is not read: of the rows that may be learned from, those of remainder INNER are measured
    and the others learned from. No result without toxic and clean examples among the latter.
    """
    sample = _sample(docs, labels, id_col, text_col, max_docs)
    return _compared(sample, _counted(sample), drifts, significants)


def _compared(sample: DataFrame, counts: Counts, drifts: tuple[float, ...], significants: tuple[float, ...]) -> list[tuple[float, float, float, float]]:
    weights, found = _weights(counts, inner=False), []
    for drift in drifts if weights is not None else ():
        model = Model(weights, drift=drift)
        segmented = _segmented(sample, model)
        model = _scaled(model, segmented.where("not inner"))
        seen = _evidence(segmented, model, significants).toPandas()  # one row a training text
        y, inner, x = seen.toxic.to_numpy(dtype=float), seen.inner.to_numpy(dtype=bool), np.array(seen.x.tolist())
        for i, significant in enumerate(significants):
            model.slope, model.intercept = fit_logistic(x[~inner, i], y[~inner])
            told = np.array([probability(v, model) >= THRESHOLD for v in x[inner, i]], dtype=bool)
            hits = float((told & (y[inner] == 1)).sum())
            found.append((drift, significant, hits / max(1, told.sum()), hits / max(1.0, y[inner].sum())))
    return found


@dataclass
class Counts:
    """Of a sample: its texts by (toxic, inner), and in how many of them each feature is, as a written table."""

    texts: dict[tuple[int, bool], int]
    features: DataFrame


def _counted(sample: DataFrame) -> Counts:
    texts = {(r.toxic, r.inner): r.n for r in sample.groupBy("toxic", "inner").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sample.select("text", "toxic", "inner").transform(map_pandas, _count_features, "feature string, n1 long, n0 long, i1 long, i0 long")
    return Counts(texts, stage(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "i1", "i0")]), "toxicity-features"))


def _weights(counts: Counts, inner: bool = True) -> dict[str, float] | None:
    """The log-odds of the features that count, with or without inner texts; None without toxic or without clean ones."""
    d1, d0 = (sum(n for (toxic, i), n in counts.texts.items() if toxic == label and (inner or not i)) for label in (1, 0))
    if not d1 or not d0:
        return None
    n1, n0 = (F.col(f"n{label}") if inner else F.col(f"n{label}") - F.col(f"i{label}") for label in (1, 0))
    odds, z = log_odds(F.col("n1"), F.col("n0"), d1, d0)
    best = (
        counts.features.select("feature", n1.alias("n1"), n0.alias("n0"))
        .where("n1 + n0 >= 3")
        .select("feature", odds.alias("odds"), z.alias("z"))
        .where((F.abs("z") >= MIN_Z) & ((F.col("odds") < 0) | (F.col("odds") >= MIN_ODDS)))
        .orderBy(F.desc(F.abs("z")), "feature")
        .limit(MAX_FEATURES)
        .collect()
    )
    return {r.feature: r.odds for r in best}


def solve_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """The lambda above zero with E exp(lambda * value) = 1, where the mean of the values is below zero."""
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        value = float((counts * np.exp(np.minimum(500.0, mid * values))).sum() / counts.sum())
        low, high = (mid, high) if value < 1 else (low, mid)
    return (low + high) / 2


def _segmented(sample: DataFrame, model: Model) -> DataFrame:
    """What lambda, K and evidence are found from, as a written table, so that a text is scored once for a model.

    Rows of texts: inner, toxic, tokens and scores (of all maximal segments). Rows of how many tokens of clean texts
    have a score, in steps: inner, step, times; at most as many a batch as the features have different scores.
    """

    def run(batches):
        scorer = Scorer(model)
        for pdf in batches:
            tokens, scores, spread = [], [], {True: Counter(), False: Counter()}
            for text, inner, toxic in zip(pdf["text"], pdf["inner"], pdf["toxic"], strict=True):
                found = np.array(scorer.tokens(text or ""), dtype=np.float64)
                with_it = np.cumsum(found)
                above = np.flatnonzero(found > 0)
                before = np.where(above > 0, with_it[above - 1], 0.0)
                tokens.append(len(found))
                scores.append([s[2] for s in segments(list(zip(above.tolist(), before.tolist(), with_it[above].tolist(), strict=True)))])
                if not toxic:
                    spread[bool(inner)].update(dict(zip(*(v.tolist() for v in np.unique(np.rint(STEPS * found).astype(np.int64), return_counts=True)), strict=True)))
            yield pd.DataFrame({"inner": pdf["inner"], "toxic": pdf["toxic"], "tokens": tokens, "scores": scores, "step": pd.array([None] * len(pdf), "Int64"), "times": 0})
            rows = [(inner, step, n) for inner, seen in spread.items() for step, n in seen.items()]
            if rows:
                told = pd.DataFrame(rows, columns=["inner", "step", "times"])
                yield told.assign(toxic=pd.array([None] * len(rows), "Int32"), tokens=0, scores=[[]] * len(rows), step=told["step"].astype("Int64"))

    rows = sample.transform(map_pandas, run, "inner boolean, toxic int, tokens long, scores array<double>, step long, times long")
    return stage(rows, "toxicity-segments")


def _evidence(segmented: DataFrame, model: Model, significants: tuple[float, ...]) -> DataFrame:
    """(inner, toxic, x) of each text, x being its evidence by the model with each of significants."""
    models = [replace(model, significant=v) for v in significants]

    def run(batches):
        for pdf in batches:
            x = [[evidence(list(s), n, m) for m in models] for s, n in zip(pdf["scores"], pdf["tokens"], strict=True)]
            yield pd.DataFrame({"inner": pdf["inner"], "toxic": pdf["toxic"], "x": x})

    texts = segmented.where("step is null").select("inner", "toxic", "tokens", "scores")
    return texts.transform(map_pandas, run, "inner boolean, toxic int, x array<double>")


def _scaled(model: Model, segmented: DataFrame) -> Model:
    """The model with lambda and K from the clean texts of a table as _segmented makes it; counts and two sums come back."""
    # at most as many rows as the features have different scores
    steps = segmented.where("step is not null").groupBy("step").agg(F.sum("times").alias("n")).toPandas()
    if not len(steps) or steps.step.max() <= 0:  # no clean token is above zero: any hit is beyond chance
        steps = pd.concat([steps, pd.DataFrame({"step": [STEPS], "n": [1]})])
    model.scale = solve_scale(steps.step.to_numpy(dtype=float) / STEPS, steps.n.to_numpy(dtype=float))
    chance = F.col("tokens") * F.exp(-model.scale * F.coalesce(F.array_max("scores"), F.lit(0.0)))
    best = segmented.where("toxic = 0 and tokens > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(chance).alias("total")).first()
    if best.texts and best.total > 0:
        model.k = best.texts / best.total
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above zero) and intercept by Newton steps with a small ridge."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(w[0])), float(w[1])


def judge(text: str | None, scorer: Scorer, model: Model) -> tuple[float, list[dict]]:
    """The text's score, and its significant passages in characters of the lower-cased text."""
    n, hits = scorer.hits(text or "")
    found = segments(hits)
    score = probability(evidence([s[2] for s in found], n, model), model)
    told = [(a, b, x) for a, b, raw in found if (x := normalised(raw, n, model)) > 0]
    if not told:
        return score, []
    starts, ends, last = {a for a, _, _ in told}, {b for _, b, _ in told}, told[-1][1]
    start_at, end_at = {}, {}
    for i, m in enumerate(WORD.finditer((text or "").lower())):
        if i in starts:
            start_at[i] = m.start()
        if i in ends:
            end_at[i] = m.end()
        if i == last:
            break
    return score, [{"start": start_at[a], "end": end_at[b], "evidence": x} for a, b, x in told]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_passages, passages (start, end, evidence in characters
    of the lower-cased text) for every segment that chance does not explain.

    Null and empty texts get the score of a text without a hit; a text is read from end to end, of any length;
    other columns are not read; repeated rows are each scored; an empty table gives an empty result.
    """

    def run(batches):
        scorer = Scorer(model)
        for pdf in batches:
            rows = [judge(text, scorer, model) for text in pdf["text"]]
            out = pdf[["doc_id", "held_out"]].copy()
            out["score"] = [r[0] for r in rows]
            out["predicted"] = [int(r[0] >= THRESHOLD) for r in rows]
            out["n_passages"] = [len(r[1]) for r in rows]
            out["passages"] = [r[1] for r in rows]
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.transform(
        map_pandas,
        run,
        f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages int, "
        "passages array<struct<start:int,end:int,evidence:double>>",
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below THRESHOLD, with all their columns, whatever their names.

    Null and empty texts stay unless the model takes a text without a hit for toxic; repeated rows go or stay
    together; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                n, hits = scorer.hits(text.as_py() or "")
                keep.append(probability(evidence([s[2] for s in segments(hits)], n, model), model) < THRESHOLD)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
