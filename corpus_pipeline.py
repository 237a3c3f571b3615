"""A corpus from raw documents to token files, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigevents.llm import binary_tokens, decontamination, jaccard, language_id, mixing
from sigevents.llm.common import keyed, scratch_path, without
from sigevents.shipping import ship


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is unsure, which are those without letters among others.

    All stages keep all columns of ``docs`` but the last one, whatever their names, and have an empty
    table for an empty one. Here: null and empty texts go; repeated rows stay or go together.
    """
    ship(spark)
    return language_id.of_known_language(docs, ~language_id.held_out())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, and of rows that repeat it one.

    Rows without an id come last; documents without words are in no group and stay.
    """
    ship(spark)
    docs = keyed(docs, "doc_id", "text", whole=True)
    return without(docs, jaccard.spare_rows(docs))


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item's window. Each row is judged by its own text, null ones hold none."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = keyed(docs, "doc_id", "text", whole=True)
    return without(docs, decontamination.row_hits(docs, benchmark).where("n_hit > 0"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken in several epochs is there as often. Null texts weigh nothing and can be taken."""
    return mixing.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in order of their ids, and what they hold of each row; null texts give an end id alone."""
    ship(spark)
    return binary_tokens.token_table(docs, pieces=100_000, text_bytes=2 << 20)  # executors still hold what the stages before left


STAGES = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark_text),
    ("mixing to target weights", mixed),
    ("token planes", token_files),
]

#: Language ID and token ids have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
