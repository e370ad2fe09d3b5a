"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors in double.

Queries fall into blocks and candidates into stripes; every pair of a block and a stripe is one cell, whose
rows reach a task sorted with the queries first. The task streams the stripe in tiles. A tile's int8 product
gives every score to within a bound that follows from the rounding; pairs that cannot be among the best k
are dropped, the others are computed again in double precision, in component order. Every cell keeps the k
best of each query; heaps merge the cells. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, map_pandas, stage

QUERY_BLOCK = 4096
STRIPE = 4096
MAX_STRIPES = 64
TILE = 1024
PAIRS = 200_000


class Block:
    """The queries of one cell, with the k best of each so far."""

    def __init__(self, k: int):
        self.k = k
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.ready = False

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def _prepare(self) -> None:
        self.id, self.x = np.concatenate(self.ids), np.concatenate(self.vectors)
        self.scale, self.q, self.l1, self.ql1 = quantise(self.x)
        self.best = np.full((len(self.id), self.k), -np.inf)
        self.who = np.full((len(self.id), self.k), np.iinfo(np.int64).max)
        self.ready = True

    def tile(self, ids: np.ndarray, y: np.ndarray) -> None:
        if not self.ready:
            self._prepare()
        scale, q, l1, ql1 = quantise(y)
        # products of int8 values are exact in float32 up to 1,040 components, in float64 beyond
        kind = np.float32 if y.shape[1] <= 1040 else np.float64
        near = (self.q.astype(kind) @ q.astype(kind).T).astype(np.float64) * self.scale[:, None] * scale[None, :]
        error = 0.5 * (self.scale[:, None] * l1[None, :] + (self.ql1)[:, None] * scale[None, :])
        error += 1e-9 * (np.abs(near) + error)
        own = self.id[:, None] == ids[None, :]
        least = near - error
        least[own] = -np.inf
        bar = self.best[:, -1]
        if len(ids) >= self.k:
            bar = np.maximum(bar, np.partition(least, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        rows, cols = np.nonzero((near + error >= bar[:, None]) & ~own)
        for at in range(0, len(rows), PAIRS):
            self._keep(rows[at : at + PAIRS], cols[at : at + PAIRS], ids, y)

    def _keep(self, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        score = np.zeros(len(rows))
        for j in range(y.shape[1]):
            score += self.x[rows, j] * y[cols, j]
        touched = np.unique(rows)
        who = np.concatenate([np.repeat(touched, self.k), rows])
        value = np.concatenate([self.best[touched].ravel(), score])
        vec = np.concatenate([self.who[touched].ravel(), ids[cols]])
        order = np.lexsort((vec, -value, who))
        who, value, vec = who[order], value[order], vec[order]
        first = np.searchsorted(who, touched)
        take = (first[:, None] + np.arange(self.k)[None, :]).ravel()
        self.best[touched] = value[take].reshape(-1, self.k)
        self.who[touched] = vec[take].reshape(-1, self.k)

    def result(self) -> pa.RecordBatch | None:
        if not self.ready:
            return None
        found = [v > -np.inf for v in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.id, pa.int64()),
                pa.array([b[f] for b, f in zip(self.best, found, strict=True)], pa.list_(pa.float64())),
                pa.array([w[f] for w, f in zip(self.who, found, strict=True)], pa.list_(pa.int64())),
            ],
            names=["query_id", "scores", "ids"],
        )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scale, int8 values, and the sums of absolute values of the vectors and of what they are rounded to."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return scale, q, np.abs(x).sum(axis=1), np.abs(q.astype(np.float64)).sum(axis=1) * scale


def _cells(k: int):
    def run(batches):
        cell, block, ids, vectors, held = None, None, [], [], 0

        def flush():
            nonlocal ids, vectors, held
            if held:
                all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
                for at in range(0, held, TILE):
                    block.tile(all_ids[at : at + TILE], all_vectors[at : at + TILE])
            ids, vectors, held = [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            vec_id = batch.column(4).to_numpy(zero_copy_only=False)
            embedding = batch.column(5)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                dim, qb, stripe, kind = (int(i) for i in key[a])
                if (dim, qb, stripe) != cell:
                    flush()
                    if block is not None and (out := block.result()) is not None:
                        yield out
                    cell, block = (dim, qb, stripe), Block(k)
                x = embedding.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, dim)
                if kind == 0:
                    block.add(vec_id[a:b], x)
                elif block.ids:
                    ids.append(vec_id[a:b])
                    vectors.append(x)
                    held += b - a
                    if held >= TILE:
                        flush()
        flush()
        if block is not None and (out := block.result()) is not None:
            yield out

    return run


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    stripe: int = STRIPE,
) -> DataFrame:
    """The k rows of largest inner product for every row that is_query selects: query_id, rank, vec_id, score.

    Ties go to the smaller id. Rows without an id and vectors that are null, empty, zero, or hold a null or
    a non-finite component take no part; vectors are only compared with those of their length; of rows that
    repeat an id the smallest vector counts. With fewer than k candidates all are returned, with none no
    row. Other columns are not read.
    """
    spark = vectors.sparkSession
    x = F.col("x")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
        .where(sound)
        .groupBy("vec_id")
        .agg(F.min("x").alias("x"))
        .withColumn("dim", F.size("x"))
    )
    rows = stage(rows, "vectors")
    n, nq = rows.count(), rows.where(is_query(F.col("vec_id"))).count()
    blocks = max(1, -(-nq // query_block))
    stripes = max(1, min(MAX_STRIPES, -(-n // stripe)))
    mixed = F.xxhash64("vec_id")
    queries = rows.where(is_query(F.col("vec_id"))).select(
        "dim",
        F.pmod(mixed, F.lit(blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
        F.lit(0).alias("kind"),
        "vec_id",
        "x",
    )
    candidates = rows.select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"),
        F.pmod(mixed, F.lit(stripes)).cast("int").alias("stripe"),
        F.lit(1).alias("kind"),
        "vec_id",
        "x",
    )
    cells = blocks * stripes
    tiles = (
        queries.unionByName(candidates)
        .repartition(max(cells, 1), "dim", "qb", "stripe")
        .sortWithinPartitions("dim", "qb", "stripe", "kind")
        .transform(map_arrow, _cells(k), "query_id long, scores array<double>, ids array<long>")
    )
    # at most MAX_STRIPES lists of k for each query
    lists = tiles.groupBy("query_id").agg(F.collect_list(F.struct("scores", "ids")).alias("lists"))

    def merge(batches):
        for pdf in batches:
            out = []
            for query, found in zip(pdf["query_id"], pdf["lists"], strict=True):
                heaps = [[(-s, i) for s, i in zip(f["scores"], f["ids"], strict=True)] for f in found]
                for rank, (score, i) in enumerate(heapq.merge(*heaps), 1):
                    if rank > k:
                        break
                    out.append((query, rank, i, -score))
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return lists.transform(map_pandas, merge, "query_id long, rank int, vec_id long, score double")
