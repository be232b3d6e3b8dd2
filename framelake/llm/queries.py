"""The registered queries over training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.alignment import aligned_documents
from framelake.llm.archives import converted_pages
from framelake.llm.crf import document_quality
from framelake.llm.langid import predicted_languages
from framelake.llm.middles import rearranged_documents
from framelake.llm.minhash import document_fingerprints
from framelake.llm.mixing import mixed_documents
from framelake.llm.perplexity import rule_verdicts
from framelake.llm.pieces import encoded_documents
from framelake.llm.secrets import scanned_documents
from framelake.llm.sharding import balanced_shards
from framelake.llm.simhash import simhash_components
from framelake.llm.sql import ORACLE_SQL
from framelake.llm.toxicity import document_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_documents(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op3_document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def op5_predicted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(table(spark, sf_dir, "documents"))


def op6_mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def op7_encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_document_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(table(spark, sf_dir, "documents"))


def op11_rearranged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rearranged_documents(table(spark, sf_dir, "documents"))


def op12_converted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_pages(table(spark, sf_dir, "pages"))


def op13_aligned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_scanned_documents,
        op2_document_fingerprints,
        op3_document_quality,
        op4_balanced_shards,
        op5_predicted_languages,
        op6_mixed_documents,
        op7_encoded_documents,
        op8_simhash_components,
        op9_document_toxicity,
        op10_rule_verdicts,
        op11_rearranged_documents,
        op12_converted_pages,
        op13_aligned_documents,
    )
}
__all__ = ["ORACLE_SQL", "QUERIES"]
