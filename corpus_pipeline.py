"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactspark.llm import line_dedup, mixing, pieces, quality, simhash
from pactspark.llm.common import new_folder, table, temporary
from pactspark.llm.queries import MIXTURE


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; rows of one id and text go or stay together; without
    labels or documents every score is one half and all stay.
    """
    rows = quality.featurise(docs)
    return quality.keep_good(rows, quality.train(rows, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages go out of the texts; all documents and columns stay.

    The first occurrence by doc_id (null first) stays; a null text stays null; an empty table gives none.
    """
    return line_dedup.dedup_lines(docs, count=None)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id, a null one last.

    Texts without words, null ones included, are near-duplicates of each other; equal rows leave one.
    """
    return simhash.drop_near_duplicates(docs, least=0.8, budget=26, errors=1)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights.

    The lot goes by doc_id (by the text, if that is null), so equal rows share theirs; documents without words
    stay; null sources and languages make one class; an empty table gives none.
    """
    return mixing.sample(docs, MIXTURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; null and empty texts have none, and repeated rows stay."""
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encode),
]

#: A trained classifier, a fingerprint join and piece encoding have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"pipeline-{k}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
