"""The operators' queries for the driver entry module, one thin query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import featurise, score_documents, train

    rows = featurise(table(spark, sf_dir, "documents"), ["doc_id"])
    return score_documents(rows, train(rows, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = near_duplicates(docs, width=4, words=1, budget=4)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "removed_lines")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Target shares of tokens: sources, and less so languages and topics, nearer to each other than the corpus has them.
MIXTURE = {"source": 0.7, "lang": 0.85, "topic": 0.85}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import weigh

    found = weigh(table(spark, sf_dir, "documents"), MIXTURE)
    return found.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("rate", 6).alias("probability"), (F.col("copies") > 0).alias("sampled"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset_hash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_pieces, op4_warc, op5_html_text, op6_line_dedup, op7_embedding_dedup, op8_mixing, op9_fingerprints, op10_token_counts, pipeline)}


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest FROM p),
f AS (SELECT digest AS of_digest, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n < 1000 OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n < 1000 OR first = page_id THEN NULL ELSE first END AS refers_to, true AS verified
FROM d LEFT JOIN f ON digest = of_digest
"""
_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id, (SELECT min(b) FROM reach WHERE a = vec_id) = vec_id AS kept
FROM embeddings
"""


def oracle_sql() -> dict[str, str]:
    """The others need a trained model, a fingerprint join, markup or a tokenizer; tests hold them against brute force."""
    from .mixing_sql import sql

    return {"op4_warc": _WARC, "op7_embedding_dedup": _VECTORS, "op8_mixing": sql(MIXTURE)}
