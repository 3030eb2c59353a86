"""From raw documents to training ids: classify, drop exact and near copies, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, exact_dedup, jaccard_join, piece_transducer, quality
from folio.llm.queries import site_of, vocabulary
from folio.llm.shared import written
from folio.tables import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"), **site_of(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked sets the document with the smallest id stays."""
    return jaccard_join.first_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces and their ids."""
    return piece_transducer.encode(docs, vocabulary("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("sentencepiece_encoding", encode_pieces),
]

#: The classifier's fitted weights and the transducer's shortest paths can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
