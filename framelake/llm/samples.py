"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, bounds: dict[int, int], max_bytes: int, max_lines: int | None = None) -> DataFrame:
    """(text, label) of docs(doc_id, text), at most bounds[v] rows for each value v of labels(doc_id, label).

    Documents are taken in the order of a hash of doc_id, from the labels alone, so only the chosen ids (as
    many as the bounds say) are sent to the documents. A document with several labels counts as the largest; a
    doc_id with several texts gives its smallest one. Documents without a text, of over `max_bytes` or over
    `max_lines` lines are passed over. Null and other labels teach nothing.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picks: DataFrame | None = None
    for value, n in bounds.items():
        own = known.where(F.col("label") == value).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(n)
        picks = own if picks is None else picks.union(own)
    chosen = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    if max_lines is not None:
        chosen = chosen.where(F.regexp_count("text", F.lit("\n")) < max_lines)
    chosen = chosen.join(F.broadcast(picks), "doc_id")
    return chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", F.col("label").cast("int").alias("label"))
