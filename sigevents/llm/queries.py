"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigevents.llm import binary_tokens, conversations, decontamination, jaccard, language_id, language_model, main_text, minhash, mixing, neighbours, spelling, toxicity, url_filter
from sigevents.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for the mix, once for each epoch; nulls and repeats as in mixing.py."""
    return mixing.mixture_table(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and baseline scores of all whole documents; null texts are an end alone (language_model.py)."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents; texts without words link with nothing (jaccard.py)."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector among all; invalid vectors take no part (neighbours.py)."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), ef=160)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, empty for null pages (main_text.py)."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, `und` without letters (language_id.py)."""
    return language_id.language_table(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document (decontamination.py)."""
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from labels outside the held-out part (toxicity.py)."""
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or else by the classifier (url_filter.py)."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of every document, read back from them (binary_tokens.py)."""
    return binary_tokens.token_table(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all whole documents (spelling.py)."""
    return spelling.variant_table(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes, components and who stays of all documents; texts without words link with nothing (minhash.py)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation; nulls are one space (conversations.py)."""
    return conversations.repair_table(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_lm_scores, op3_ngram_jaccard, op4_nearest_neighbours, op5_main_text, op6_language_id, op7_decontamination, op8_toxicity, op9_url_filter, op10_token_planes, op11_spelling_variants, op12_minhash_dedup, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE_SQL, "op3_ngram_jaccard": jaccard.ORACLE_SQL, "op7_decontamination": decontamination.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_minhash_dedup": minhash.ORACLE_SQL, "op13_conversation_repair": conversations.ORACLE_SQL}
