"""The corpus pipeline: toxicity, exact copies, near copies, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last
return the columns of documents. The driver of the pipeline writes each result as Parquet and reads it again
as the next stage's docs; run does the same in the folder of spark.checkpoint.dir.

In every stage null texts count as empty, repeated rows are rows of their own (the copies among them go in the
two stages for copies), an empty table stays empty, and columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from tessera.llm.common import NULL_ID, fresh, stage, table, text_keys, text_sha


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go; all others stay as they are.

    The model learns from the labelled documents outside the held-out quarter.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z the row of the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at 0.8 or more the document of the smallest doc_id stays.

    Texts of one id, or of null, are documents of their own, in the order of their SHA-256.
    """
    kept_id, kept_sha = fresh(docs.columns, "kept_id", "kept_sha")
    node, sha = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), text_sha(docs["text"])
    keys = text_keys(stage(docs.select(node.alias("doc"), sha.alias("sha")), "digests"))
    if keys is None:
        kept = near_dedup.near_copies(docs).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(kept_id)).distinct()
        return docs.join(kept, node == F.col(kept_id), "left_semi")
    keyed = docs.select(node.alias("doc"), sha.alias("sha"), "text").join(keys, ["doc", "sha"])
    found = near_dedup.near_copies(stage(keyed.select(F.col("node").alias("doc_id"), "text"), "keyed"))
    kept = found.where("kept").select(F.col("doc_id").alias("node")).distinct().join(keys, "node")
    kept = kept.select(F.col("doc").alias(kept_id), F.col("sha").alias(kept_sha))
    return docs.join(kept, (node == F.col(kept_id)) & (sha == F.col(kept_sha)), "left_semi")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated so that the expected tokens of the languages meet mixing.TARGETS; none is lost."""
    labelled = mixing.labelled_languages(docs, table(spark, sf_dir, "labels"))
    model = mixing.train(labelled, list(mixing.TARGETS))
    return mixing.repeat_to_targets(docs, model, mixing.TARGETS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens and the ids of its whole text."""
    encoded = sentencepiece_codec.encode(docs)
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("sentencepiece", tokenise),
]
#: SQL can express neither the trained stages nor the tokeniser; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
