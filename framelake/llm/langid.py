"""Language identification by rank-order profiles of letter n-grams and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.textarrays import BLOCK_BYTES, mix

#: Most frequent n-grams of a document and of a language that are compared.
PROFILE = 300
#: Distinct n-grams of a partition that are merged before their counts are sent on.
FLUSH = 1_000_000
_KEY = 40
_SPACE = 1


@cache
def _letters() -> np.ndarray:
    """Code point of each letter, 1 (a space) for all else."""
    return np.fromiter((c if chr(c).isalpha() else _SPACE for c in range(0x110000)), np.uint32, 0x110000)


def gram_keys(texts: list[str]) -> tuple[np.ndarray, int]:
    """text << 40 | key, sorted, for each run of 1 to 3 letters of each lower-cased text, and the number of texts.

    Words are padded with one space on either side; a run holds no space but as its first or last sign.
    """
    lowered = [f" {t.lower()} " for t in texts]
    sign = _letters()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in lowered])
    letter = sign != _SPACE
    pair = sign[:-1] << np.uint64(21) | sign[1:]
    triple = pair[:-1] << np.uint64(21) | sign[2:]
    found = []
    for keys, use, n in ((sign, letter, 0), (pair, (letter[:-1] | letter[1:]), 1), (triple, letter[1:-1], 2)):
        at = np.flatnonzero(use)
        at = at[doc[at] == doc[at + n]] if n else at
        found.append(doc[at] << np.uint64(_KEY) | mix(keys[at]) >> np.uint64(64 - _KEY))
    out = np.concatenate(found).view(np.int64)
    out.sort()
    return out, len(texts)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges with about BLOCK_BYTES / 4 signs."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= BLOCK_BYTES // 4:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n) of a partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(keys[at]), pa.array(np.add.reduceat(n, at))], ["lang", "gram", "n"])

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
        for first, end in _pieces(texts):
            for lang in sorted(set(langs[first:end])):
                own = [texts[i] for i in range(first, end) if langs[i] == lang and texts[i]]
                keys, n = _runs(np.sort(gram_keys(own)[0] & ((1 << _KEY) - 1)))
                if len(keys):
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
            if size > FLUSH:
                yield from merged()
                held, size = {}, 0
    yield from merged()


def language_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the `size` most frequent n-grams of each language of docs(text, lang).

    Rows without text or lang teach nothing. Ties go to the smaller key.
    """
    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.xxhash64("gram"), F.lit(64))
    first = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def distances(texts: list[str], keys: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    """Out-of-place distance (0 to 1) of each text to each language: ranks[language, position of a key], absent is `size`."""
    grams, n = _runs(gram_keys(texts)[0])
    doc, gram = grams >> _KEY, grams & ((1 << _KEY) - 1)
    order = np.argsort(doc << 40 | ((1 << 40) - 1 - n), kind="stable")  # by text, then falling count; a block has under 2^23 texts
    doc, gram = doc[order], gram[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
    top = place < size
    doc, gram, place = doc[top], gram[top], place[top]
    at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
    known = keys[at] == gram
    out = np.ones((len(texts), len(ranks)))
    n = np.bincount(doc, minlength=len(texts))
    for k, rank in enumerate(ranks):
        there = np.where(known, rank[at], size)
        off = np.where(there < size, np.abs(there - place), size)
        out[:, k] = np.where(n > 0, np.bincount(doc, off, len(texts)) / (np.maximum(n, 1) * size), 1.0)
    return out


def _predictor(model, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, keys, ranks = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [], []
            for first, end in _pieces(texts):
                own = [t or "" for t in texts[first:end]]
                far = distances(own, keys, ranks, size) if langs else np.ones((len(own), 1))
                best, rest = far.argmin(1), np.sort(far, 1)
                sure = 1 - rest[:, 0] if far.shape[1] == 1 else rest[:, 1] / np.maximum(rest[:, 0] + rest[:, 1], 1e-12)
                for t, b, s in zip(own, best.tolist(), sure.tolist(), strict=True):
                    some = langs and any(c.isalpha() for c in t)
                    names.append(langs[b] if some else "und")
                    scores.append(s if some else 0.0)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """docs(row, text) as (row, lang_pred, score): the nearest profile, ties to the first language by name.

    The score is the runner-up's share of the two smallest distances (0.5: a tie, 1: an exact match).
    Null texts and texts without a letter are `und` with score 0; so are all without any profile.
    The profiles are `size` rows a language, collected and sent to every task.
    """
    spark = docs.sparkSession
    rows = profiles.toPandas()
    langs = sorted(rows["lang"].unique())
    keys = np.unique(rows["gram"].to_numpy(np.int64))
    ranks = np.full((len(langs), len(keys)), size, np.int64)
    ranks[np.searchsorted(langs, rows["lang"].to_numpy(str)) if langs else [], np.searchsorted(keys, rows["gram"].to_numpy(np.int64))] = rows["rank"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(([str(x) for x in langs], keys, ranks))
    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(_predictor(held, size), f"row {kind}, lang_pred string, score double")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of documents.

    Learns from the text and non-null lang of rows whose crc32(doc_id) mod 5 is not 0. Repeated rows
    stay; an empty table gives an empty result.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    profiles = language_profiles(rows.where("not held_out"))
    found = identified(rows.select(F.struct("doc_id", "held_out").alias("row"), "text"), profiles)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")
