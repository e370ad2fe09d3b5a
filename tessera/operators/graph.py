"""Import resolution and importance over the import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import written

DAMPING, ITERATIONS = 0.85, 20


def first_candidate(specs: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """specs (key..., candidates array) with the first candidate that is a file's path, as target."""
    ranked = specs.select(*key, F.posexplode("candidates").alias("rank", "candidate"))
    hits = ranked.join(files.select(F.col("path").alias("candidate")), "candidate")
    return hits.groupBy(*key).agg(F.min_by("candidate", "rank").alias("target"))


#: The steps that one written table takes further: each uses the one before twice.
STEPS_WRITTEN = 4


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(node, importance): PageRank after a fixed number of steps, divided by its mean, to four places.

    Every edge row counts, repeated ones too. A node without edges spreads its rank over all. What that adds is the same
    for every node, so that the rank after k steps is a sum of the vectors that come of passing ones along the edges
    0 to k times, and its factors follow from the sums of these vectors: no step waits for a number from the driver,
    which sees one row of sums at the end.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    shares = written(edges.join(degree, "src").groupBy("src", "dst").agg((F.count(F.lit(1)) / F.first("degree") * damping).alias("share")))
    state = written(nodes.select("node", F.array(F.lit(1.0)).alias("passed")))
    for step in range(1, iterations + 1):
        inflow = (
            shares.join(state.select(F.col("node").alias("src"), F.element_at("passed", -1).alias("last")), "src")
            .groupBy(F.col("dst").alias("to"))
            .agg(F.sum(F.col("last") * F.col("share")).alias("inflow"))
        )
        state = state.join(inflow, F.col("node") == F.col("to"), "left").select(
            "node", F.concat("passed", F.array(F.coalesce("inflow", F.lit(0.0)))).alias("passed")
        )
        if step % STEPS_WRITTEN == 0 or step == iterations:
            state = written(state)
    sums = state.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("passed", F.lit(i))).alias(f"s{i}") for i in range(iterations + 1)]).first()
    n = sums.n
    if not n:
        return state.select("node", F.lit(0.0).alias("importance"))
    factors = [1.0 / n]
    for _ in range(iterations):
        passed = sum(f * sums[f"s{i + 1}"] for i, f in enumerate(factors)) / damping
        factors = [(1 - damping) / n + damping * (1 - passed) / n, *factors]
    rank = sum((F.get("passed", F.lit(i)) * (f * n) for i, f in enumerate(factors)), F.lit(0.0))
    return state.select("node", F.round(rank, 4).alias("importance"))
