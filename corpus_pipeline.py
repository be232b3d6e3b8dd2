"""Five stages from raw documents to token ids: quality, near duplicates, secrets, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.crf import fit_quality, scored_quality, taught
from framelake.llm.mixing import mixed
from framelake.llm.neardup import without_near_duplicates
from framelake.llm.pieces import encoded
from framelake.llm.secrets import redacted
from framelake.llm.storage import written

#: Documents that the quality model scores under this go.
LEAST_QUALITY = 0.3
#: Most passes over a source in the mixture.
MAX_REPEATS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model doesn't reject; it learns from labels as in the registered query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(docs, taught(labels))
    scores = scored_quality(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scores.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts (five-word shingles, similarity 0.8): that with the smallest doc_id."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return redacted(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the temperature mixture draws it, once at least."""
    drawn = mixed(docs, docs.columns, max_repeats=MAX_REPEATS)
    return drawn.select("row.*", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("_pass")).drop("_pass")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document."""
    out = encoded(docs, keep=("doc_id", "lang", "source"))
    return out.select("row.*", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("encoding", encoding)]

#: A fitted model and an iterative search are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each from the written table of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
