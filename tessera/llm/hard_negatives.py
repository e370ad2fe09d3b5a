"""Hard negatives by angular triangle filtering.

Scores are integer inner products of vectors whose components are rounded down to steps of 1 / SCALE. Every vector
stores its angles to a few reference directions. By the triangle inequality on the sphere the angle between an anchor
and a row lies, for every reference, between the difference and the sum of their angles to it (or what is left of the
full circle); the narrowest of these intervals, as cosines, times the two norms bounds the score, with a margin for
rounding. An integer score is only computed where that interval overlaps a window that still takes rows: for the
positives everything from the k-th best so far, for the negatives the window that a positive's score sets, from the
last that would still be returned.

Anchors fall into blocks and rows into stripes by a hash of their ids; each pair of a block and a stripe is a cell,
which streams its stripe in tiles, labels apart. The best of the cells are ranked by Spark's windows. The result is
exact whatever the references are; they only say how much is computed. In many dimensions random directions all
stand at right angles, and little is filtered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, shuffle_partitions, stage

SCALE = 256
REFERENCES = 16
#: References are chosen among at most about so many rows, taken by a hash of their ids.
SAMPLE = 2048
ANCHOR_BLOCK = 4096
STRIPE, LONGEST_STRIPE = 1024, 1 << 16
TILE = 512
#: Rows of a larger norm take no part: their scores might not fit 64 bits.
MAX_NORM_SQUARED = float(1 << 62)
#: What rounding may add to an angle (kept in single precision) and to a cosine.
ANGLE_MARGIN, COSINE_MARGIN = 1e-5, 1e-6


def angles(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The angle of each row to each reference; a right angle for zero vectors, whose scores are 0 anyway."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.arccos(np.clip(x / np.maximum(norm, 1e-300) @ references.T, -1.0, 1.0)).astype(np.float32)


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n directions of the rows: the mean's nearest, then ever the row farthest from all that are chosen."""
    norm = np.linalg.norm(x, axis=1)
    u = x[norm > 0] / norm[norm > 0, None]
    if not len(u):
        return np.zeros((0, x.shape[1]))
    chosen = [int(np.argmax(u @ u.mean(axis=0)))]
    near = u @ u[chosen[0]]
    while len(chosen) < n and near.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, u @ u[chosen[-1]])
    return u[chosen]


def bounds(a: np.ndarray, x: np.ndarray, a_norm: np.ndarray, x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of every anchor with every row, of their angles and norms."""
    apart = np.zeros((len(a), len(x)), np.float32)
    wide = np.full((len(a), len(x)), np.pi, np.float32)
    for r in range(a.shape[1]):
        np.maximum(apart, np.abs(a[:, r, None] - x[None, :, r]), out=apart)
        both = a[:, r, None] + x[None, :, r]
        np.minimum(wide, np.minimum(both, np.float32(2 * np.pi) - both), out=wide)
    size = (a_norm[:, None] * x_norm[None, :]).astype(np.float64)
    most = np.cos(np.maximum(apart - ANGLE_MARGIN, 0.0)) + COSINE_MARGIN
    least = np.cos(np.minimum(wide + ANGLE_MARGIN, np.pi)) - COSINE_MARGIN
    return least * size, most * size


def products(a: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products. Partial sums stay below `largest`: doubles hold them exactly up to 2^53."""
    if largest < float(1 << 53):
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


_NONE = np.iinfo(np.int64).min


class Best:
    """Of every list the k best (score, id): higher scores, then smaller ids."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), _NONE)
        self.id = np.full((lists, k), np.iinfo(np.int64).max)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(lists)
        who = np.concatenate([np.repeat(touched, self.k), lists])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, ~score, who))  # ~ turns the order around and never overflows
        who, score, ids = who[order], score[order], ids[order]
        take = (np.searchsorted(who, touched)[:, None] + np.arange(self.k)[None, :]).ravel()
        self.score[touched] = score[take].reshape(-1, self.k)
        self.id[touched] = ids[take].reshape(-1, self.k)


class Cell:
    """The anchors of one cell in the order of their labels. windows: per anchor lists of (low, high) scores, or none."""

    def __init__(self, anchors: dict, k: int, windows: tuple[np.ndarray, np.ndarray] | None):
        order = np.argsort(anchors["label"], kind="stable")
        self.at = {name: values[order] for name, values in anchors.items()}
        self.norm = np.sqrt(self.at["squared"].astype(np.float64))
        self.low, self.high = (None, None) if windows is None else (windows[0][order], windows[1][order])
        self.lists = 1 if windows is None else self.low.shape[1]
        self.best = Best(len(order) * self.lists, k)

    def tile(self, rows: dict) -> None:
        order = np.argsort(rows["label"], kind="stable")
        rows = {name: values[order] for name, values in rows.items()}
        labels, first = np.unique(rows["label"], return_index=True)
        for label, a, b in zip(labels, first, [*first[1:], len(order)], strict=True):
            part = {name: values[a:b] for name, values in rows.items()}
            start, stop = np.searchsorted(self.at["label"], label, "left"), np.searchsorted(self.at["label"], label, "right")
            if self.low is None:
                self._score(slice(start, stop), part)
            else:
                self._score(slice(0, start), part)
                self._score(slice(stop, None), part)

    def _score(self, anchors: slice, rows: dict) -> None:
        at = np.arange(len(self.norm))[anchors]
        if not len(at) or not len(rows["id"]):
            return
        norm = np.sqrt(rows["squared"].astype(np.float64))
        least, most = bounds(self.at["angles"][anchors], rows["angles"], self.norm[anchors], norm)
        last = self.best.score.reshape(-1, self.lists, self.best.k)[anchors, :, -1]
        if self.low is None:
            open_at, high = last, None
            wanted = (most >= last[:, :1]) & (self.at["id"][anchors][:, None] != rows["id"][None, :])
        else:
            open_at, high = np.maximum(last, self.low[anchors]), self.high[anchors]
            wanted = np.zeros(most.shape, bool)
            for j in range(self.lists):
                wanted |= (most >= open_at[:, j, None]) & (least <= high[:, j, None])
        some, cols = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        if not len(some):
            return
        largest = float(self.norm[anchors][some].max() * norm[cols].max()) * 1.001
        found = products(self.at["x"][anchors][some], rows["x"][cols], largest)
        wanted, open_at = wanted[np.ix_(some, cols)], open_at[some]
        for j in range(self.lists):
            hit = wanted & (found >= open_at[:, j, None])
            if high is not None:
                hit &= found <= high[some][:, j, None]
            if len(cols) > self.best.k:  # what the tile itself has k better ones for
                bar = np.partition(np.where(hit, found, _NONE), len(cols) - self.best.k, axis=1)[:, len(cols) - self.best.k]
                hit &= found >= bar[:, None]
            r, c = np.nonzero(hit)
            if len(r):
                self.best.add(at[some][r] * self.lists + j, found[r, c], rows["id"][cols][c])

    def result(self) -> pa.RecordBatch:
        who, rank = np.nonzero(self.best.score > _NONE)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.at["id"][who // self.lists], pa.int64()),
                pa.array(who % self.lists, pa.int32()),
                pa.array(self.best.score[who, rank], pa.int64()),
                pa.array(self.best.id[who, rank], pa.int64()),
            ],
            names=["anchor_id", "list", "score", "id"],
        )


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _run(k: int, references: int, windowed: bool):
    def run(batches):
        cell, key, held, anchors = None, None, [], []

        def flush():
            nonlocal cell, held
            if cell is None and anchors and held:
                joined = {n: np.concatenate([a[n] for a in anchors]) for n in anchors[0]}
                windows = (joined.pop("low"), joined.pop("high")) if windowed else None
                cell = Cell(joined, k, windows)
            if cell is not None and held:
                rows = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                for i in range(0, len(rows["id"]), TILE):
                    cell.tile({n: v[i : i + TILE] for n, v in rows.items()})
            held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                here = tuple(int(i) for i in keys[a, :3])
                if here != key:
                    flush()
                    if cell is not None:
                        yield cell.result()
                    cell, key, anchors = None, here, []
                part = batch.slice(a, b - a)
                rows = {
                    "id": part.column("id").to_numpy(),
                    "label": part.column("label").to_numpy(),
                    "squared": part.column("squared").to_numpy(),
                    "x": _matrix(part.column("x"), here[0], np.int64),
                    "angles": _matrix(part.column("angles"), references, np.float32),
                }
                if keys[a, 3] == 0:
                    if windowed:
                        windows = part.column("windows")
                        ends, width = windows.flatten(), len(windows[0])
                        rows |= {n: ends.field(n).to_numpy(zero_copy_only=False).reshape(b - a, width) for n in ("low", "high")}
                    anchors.append(rows)
                elif anchors:
                    held.append(rows)
                    if sum(len(h["id"]) for h in held) >= TILE:
                        flush()
        flush()
        if cell is not None:
            yield cell.result()

    return run


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int, k: int, references: int, windowed: bool) -> DataFrame:
    """anchor_id, list, score, id: of every cell and list the k best."""
    mixed = F.xxhash64("id")
    columns = ["id", "label", "squared", "x", "angles"]
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    left = anchors.select(
        "dim", F.pmod(mixed, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
        F.lit(0).alias("kind"), *columns, (F.col("windows") if windowed else none).alias("windows"),
    )
    right = rows.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(mixed, F.lit(stripes)).cast("int").alias("stripe"),
        F.lit(1).alias("kind"), *columns, none.alias("windows"),
    )
    dealt = left.unionByName(right).repartition(blocks * stripes, "dim", "block", "stripe").sortWithinPartitions("dim", "block", "stripe", "kind")
    return dealt.transform(map_arrow, _run(k, references, windowed), "anchor_id long, list int, score long, id long")


def prepare(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows that take part: id, label, dim, squared (norm), x (integers)."""
    x = F.col("v")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    down = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    floats = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.pow(F.abs(F.lit(float(SCALE)) * c.cast("double")) + 1.0, F.lit(2.0)))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
        .where(sound)
        .where(floats < MAX_NORM_SQUARED)
        .groupBy("id")
        .agg(F.min(F.struct("label", "v")).alias("row"))
        .select("id", "row.label", "row.v")
        .select("id", "label", F.size("v").alias("dim"), down.alias("x"))
        .withColumn("squared", F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c))
    )


def _with_angles(rows: DataFrame, references: dict[int, np.ndarray], n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found = np.zeros((batch.num_rows, n), np.float32)
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("x").take(pa.array(some)), int(dim), np.float64)
                held = references.get(int(dim), np.zeros((0, int(dim))))
                got = angles(x, held)
                # missing references repeat a right angle, which says nothing
                found[some] = np.concatenate([got, np.full((len(some), n - len(held)), np.pi / 2, np.float32)], axis=1)
            listed = pa.ListArray.from_arrays(np.arange(0, found.size + 1, n, dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=[*batch.schema.names, "angles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.transform(map_arrow, run, f"{kinds}, angles array<float>")


def mine(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    label: Column | None = None,
    references: int = REFERENCES,
    block: int = ANCHOR_BLOCK,
    stripe: int = STRIPE,
) -> DataFrame:
    """The hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the first `positives` other rows of its label, by score (higher first), then id. The
    negatives of a positive of score p are the first `negatives` rows of other labels with a score from
    p * low[0] / low[1] to p * high[0] / high[1], both included; a negative p has none. label: how a row's label is
    found, where it is not simply the column.

    Rows without an id or a label and vectors that are null or hold a null or non-finite component take no part,
    nor do vectors so long that scores might not fit 64 bits (a norm of 2^31 steps and more). Zero vectors take part
    with scores of 0. Vectors are only compared with those of their length. Of rows that repeat an id the one with the
    smallest label and vector counts. Ties go to the smaller id. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(prepare(vectors, F.col(label_col) if label is None else label, id_col, vector_col), "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor(F.col("id"))).alias("anchors")).first()
    share = min(1.0, SAMPLE / max(1, counts.n))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "x").limit(2 * SAMPLE).collect()
    held: dict[int, list] = {}
    for r in chosen:
        held.setdefault(r.dim, []).append(r.x)
    found = {d: spread_out(np.array(sorted(xs), dtype=np.float64).reshape(len(xs), d), references) for d, xs in held.items()}
    rows = stage(_with_angles(rows, found, references), "angles")
    anchors = rows.where(is_anchor(F.col("id")))
    blocks = max(1, -(-counts.anchors // block))
    # cells enough for all tasks; beyond that a longer stripe is cheaper, as it streams and each cell has its anchors sent
    stripes = max(1, -(-counts.n // LONGEST_STRIPE), min(-(-counts.n // stripe), -(-8 * shuffle_partitions(spark) // blocks)))

    def ranked(cells: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("anchor_id", "list").orderBy(F.desc("score"), "id")
        return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    near = stage(ranked(_cells(anchors, rows, blocks, stripes, positives, references, False), positives), "positives")
    score = F.col("score")
    at_least, at_most = F.expr(f"-({_part('-score', low)})"), F.expr(_part("score", high))
    nothing = F.struct(F.lit((1 << 63) - 1).alias("low"), F.lit(-(1 << 63) + 1).alias("high"))
    wanted = F.when(score >= 0, F.struct(at_least.alias("low"), at_most.alias("high"))).otherwise(nothing)
    held_windows = near.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", wanted.alias("w")))).alias("by_rank"))
    windows = held_windows.select(
        F.col("anchor_id").alias("id"),
        F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("by_rank", i), nothing)).alias("windows"),
    )
    open_anchors = anchors.join(windows, "id")
    far = ranked(_cells(open_anchors, rows, blocks, stripes, negatives, references, True), negatives)
    pairs = near.select("anchor_id", (F.col("rank") - 1).alias("list"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    return pairs.join(far, ["anchor_id", "list"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", score.alias("negative_score")
    )


def _part(value: str, part: tuple[int, int]) -> str:
    """SQL for the whole part of value * part[0] / part[1], rounded down, whose steps fit 64 bits."""
    num, den = part
    return f"(({value}) - pmod({value}, {den})) div {den} * {num} + pmod({value}, {den}) * {num} div {den}"
