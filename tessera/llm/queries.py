"""The registered queries of the llm operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    block_search, chat_format, exact_dedup, hard_negatives, merkle, mixing, near_dedup, repeated_spans, sentencepiece_codec, sharding,
    token_counts, toxicity, url_filter,
)
from tessera.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text as count and hash, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.round_trip(docs)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.default_labelled(spark).where("not held_out"))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("passages")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s
), u AS (SELECT doc_id, unnest(g) AS t FROM s
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id, n.doc_id = min(b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), wins AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM h WHERE len(x) >= 200)
), later AS (
  SELECT doc_id, i, (row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1)::INTEGER AS rep FROM wins
), bytes AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2)) AS i FROM h)
), covered AS (
  SELECT b.doc_id, b.i, b, coalesce(max(rep) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM bytes b LEFT JOIN later l ON l.doc_id = b.doc_id AND l.i = b.i
), marked AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head FROM covered
), cut AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id
)
SELECT h.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.labelled_languages(docs, table(spark, sf_dir, "labels"))
    model = mixing.train(labelled, list(mixing.TARGETS))
    found = mixing.rates(docs, model, mixing.TARGETS)
    posteriors = [F.round(F.get("posterior", k), 6).alias(f"p_{d}") for k, d in enumerate(mixing.TARGETS)]
    return found.select("doc_id", "n_tokens", *posteriors, F.round("rate", 6).alias("rate"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, body,
         CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || regexp_replace(replace(speaker, '<|', '< |'), '[' || chr(13) || chr(10) || ']', ' ', 'g') || chr(10) END AS header
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), g AS (SELECT *, header || body || '<|im_end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, body
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g
)
SELECT conv_id, perspective, turn, speaker, segment, start, (start + length(header))::BIGINT AS mask_start,
       (CASE WHEN speaker = perspective THEN start + length(segment) - 1 ELSE start + length(header) END)::BIGINT AS mask_end
FROM o
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""


#: DuckDB: CRC-32 of a list of bytes `b`, by the table `crc_table` of its polynomial.
_CRC_TABLE = """
crc AS (
  SELECT list(c ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
)"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, crc_table[(1 + xor(c, b) % 256)::BIGINT])))"
_DIGITS = "list_transform(range(1, len({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and every leaf climbed with the digest that its row has after the tampering."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    after = merkle.leaf_digest([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields])
    built = merkle.build(docs, fields, keep={"tampered": F.when(tampered, after)})
    proofs = merkle.prove(built, F.coalesce("tampered", "digest"))
    root, folded = F.lit(built.root), merkle.digest_text(F.col("folded"))
    return proofs.select(
        F.col("id").alias("doc_id"),
        merkle.digest_text(F.col("leaf")).alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(merkle.digest_text(F.col("siblings")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )


def _leaf_sql(n_chars: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()}, d AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS changed,
         coalesce({_CRC.format(bytes=_DIGITS.format(x="doc_id::VARCHAR"))} % 7 = 0, false) AS tampered
  FROM documents, crc
), f AS (
  SELECT *, CASE WHEN tampered THEN changed ELSE leaf END AS claim,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM d
), n(lang, lvl, pos, m, h) AS (
  SELECT lang, 0, pos, m, leaf FROM f
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM n WHERE m > 1 GROUP BY lang, lvl, pos // 2, m
), s AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM n WHERE m = 1
), t(lvl, pos, m, h) AS (
  SELECT 0, pos, m, subroot FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE m > 1 GROUP BY lvl, pos // 2, m
), c(doc_id, lang, lvl, pos, m, h, proof) AS (
  SELECT doc_id, lang, 0, pos, m, claim, '' FROM f
  UNION ALL
  SELECT c.doc_id, c.lang, c.lvl + 1, c.pos // 2, (c.m + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN n.h || c.h ELSE c.h || coalesce(n.h, '') END), c.proof || coalesce(n.h, '')
  FROM c LEFT JOIN n ON n.lang IS NOT DISTINCT FROM c.lang AND n.lvl = c.lvl AND n.pos = xor(c.pos, 1) WHERE c.m > 1
), r(doc_id, lvl, pos, m, h, proof) AS (
  SELECT c.doc_id, 0, s.pos, s.m, c.h, c.proof FROM c JOIN s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.m = 1
  UNION ALL
  SELECT r.doc_id, r.lvl + 1, r.pos // 2, (r.m + 1) // 2,
         sha256(CASE WHEN r.pos % 2 = 1 THEN t.h || r.h ELSE r.h || coalesce(t.h, '') END), r.proof || coalesce(t.h, '')
  FROM r LEFT JOIN t ON t.lvl = r.lvl AND t.pos = xor(r.pos, 1) WHERE r.m > 1
)
SELECT f.doc_id, f.leaf, s.subroot, t.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = t.h AS verified
FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang JOIN r ON r.doc_id IS NOT DISTINCT FROM f.doc_id AND r.m = 1 JOIN t ON t.m = 1
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, label=moved)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), neg AS (
  SELECT pos.*, vec_id AS negative_id, score AS negative_score, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by doc_id alone, and where a ninth would have each document."""
    return sharding.manifest(table(spark, sf_dir, "documents"), 8).withColumn("law", F.lit("key"))


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()}, d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents
), j(doc_id, shards, nxt, b, k) AS (
  SELECT doc_id, shards, 0::BIGINT, -1::BIGINT, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0) END)::UHUGEINT
  FROM documents, (VALUES (8), (9)) s(shards)
  UNION ALL
  SELECT doc_id, shards, floor((nxt + 1) * (2147483648::DOUBLE / (kk // 8589934592 + 1)::DOUBLE))::BIGINT, nxt, kk
  FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS kk FROM j WHERE nxt < shards)
), p AS (
  SELECT doc_id, max(b) FILTER (shards = 8) AS shard, max(b) FILTER (shards = 9) AS grown FROM j GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size,
       {_CRC.format(bytes="list_transform(range(0, len(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)")} AS text_crc32,
       'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown::INTEGER AS grown_shard
FROM d JOIN p USING (doc_id), crc
"""


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_sentencepiece, op2_url_filters, op3_toxicity, op4_nearest, op5_near_dedup, op6_repeated_spans, op7_token_counts,
            op8_mixing, op9_chat_format, op10_exact_dedup, op11_merkle_manifest, op12_hard_negatives, op13_sharding,
        )
    }


def oracle_sql() -> dict:
    return {
        "op4_nearest": OP4_SQL, "op5_near_dedup": OP5_SQL, "op6_repeated_spans": OP6_SQL, "op9_chat_format": OP9_SQL, "op10_exact_dedup": OP10_SQL,
        "op11_merkle_manifest": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_sharding": OP13_SQL,
    }
