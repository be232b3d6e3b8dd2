"""Vectors: hashed text features, pluggable encoders and detectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.columns import DIMENSION, embed_text, feature_bucket, token_features

Encoder = Callable[[list[str]], np.ndarray]
Detector = Callable[[pd.DataFrame], pd.DataFrame]
_WORD = re.compile("[a-z]+")


def _features(word: str) -> list[str]:
    return ["$" + word, *(word[i : i + 2] for i in range(len(word) - 1) if len(word) > 2)]


@lru_cache(maxsize=100_000)
def word_buckets(word: str, dimension: int) -> np.ndarray:
    """Buckets of a word's features, remembered over the batches of a worker."""
    return np.array([int.from_bytes(hashlib.md5(f.encode()).digest()[:4], "big") % dimension for f in _features(word)], np.int64)


def hash_counts(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Counts of each text's features in their buckets; equal texts are counted once."""
    distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    out = np.zeros((len(distinct), dimension), np.float32)
    for row, text in zip(out, distinct, strict=True):
        if found := [word_buckets(w, dimension) for w in _WORD.findall(text.lower())]:
            row[:] = np.bincount(np.concatenate(found), minlength=dimension)
    return out[[distinct[t] for t in texts]]


def hash_embedding(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """hash_counts of unit length; a text without features is all zeros."""
    out = hash_counts(texts, dimension)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def safely(encoder: Encoder, texts: list[str], batch: int = 32) -> list[np.ndarray]:
    """The encoder over batches. The texts of a batch that fails go to it one by one, and what fails then is hashed instead."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        try:
            found = list(np.asarray(encoder(part), np.float32))
            if len(found) != len(part):
                raise ValueError("an encoder gives a vector for each text")
        except Exception:  # an encoder is the caller's code: any failure has a defined result
            found = safely(encoder, part[: len(part) // 2], batch) + safely(encoder, part[len(part) // 2 :], batch) if len(part) > 1 else list(hash_embedding(part))
        out += found
    return out


_MODELS: dict[bytes, Any] = {}


def loaded(factory: Callable[[], Any]) -> Any:
    """What a factory makes, made once in a worker process for all its tasks; factories are told apart by their pickled form."""
    key = cloudpickle.dumps(factory)
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def embed_column(df: DataFrame, text_col: str, out_col: str, encoder: Encoder = hash_embedding, batch: int = 32, factory: Callable[[], Encoder] | None = None, packed: bool = False) -> DataFrame:
    """df with a vector for each text (null: the empty one's) by an encoder, or by one that a factory makes in each worker process, so that a model isn't sent with every task.

    packed: a vector is a binary value of its floats, which files hold and tasks read with less work.
    """
    make = factory if factory is not None else lambda: encoder

    @F.pandas_udf("binary" if packed else "array<float>")
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = loaded(make)
        for texts in columns:
            found = safely(own, texts.fillna("").tolist(), batch)
            yield pd.Series([v.tobytes() for v in found] if packed else found, dtype=object)

    return df.withColumn(out_col, vectors(F.col(text_col)))


def embed_frames(frames: DataFrame, encoder: Encoder = hash_embedding, batch: int = 32, factory: Callable[[], Encoder] | None = None, packed: bool = False) -> DataFrame:
    """frames with embedding and text_embedding from their tags (their id without any), by an encoder or a factory of one."""
    text = frames.withColumn("_text", embed_text(F.col("tags"), F.col("id")))
    out = embed_column(text, "_text", "text_embedding", encoder, batch, factory, packed)
    return out.withColumn("embedding", F.col("text_embedding")).drop("_text")


def sparse_embedding(df: DataFrame, key: str, text_col: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, bucket, n, weight): the non-zero places of each distinct key's hash embedding, by built-in functions."""
    rows = df.select(key, F.explode(token_features(F.col(text_col))).alias("f")).groupBy(key, feature_bucket(F.col("f"), dimension).alias("bucket")).agg(F.count("*").alias("n"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("_norm"))
    return rows.join(norms, key).select(key, "bucket", "n", (F.col("n") / F.col("_norm")).alias("weight"))


_DETECTED = "frame_id string, det_idx int, label string, confidence double, bbox array<double>, frame_area double"


def detect_frames(images: DataFrame, model: Detector | None = None, factory: Callable[[], Detector] | None = None) -> DataFrame:
    """Detections of images(frame_id, image) by the caller's model, or by one that a factory makes in each worker process; none without either.

    The model takes a batch (frame_id, height, width, data) and returns (frame_id, det_idx, label, confidence, bbox, frame_area).
    Images without pixels are left out. The images of a batch that fails go to the model one by one, and what fails then has no detections.
    """
    make = factory if factory is not None else lambda: model
    names = [f.split()[0] for f in _DETECTED.split(", ")]

    def found(own: Detector, batch: pd.DataFrame) -> pd.DataFrame:
        try:
            return own(batch)[names]
        except Exception:  # a model is the caller's code
            if len(batch) < 2:
                return pd.DataFrame(columns=names)
            parts = [p for i in range(len(batch)) if len(p := found(own, batch.iloc[i : i + 1]))]
            return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = loaded(make)
        for batch in batches:
            if own is not None and len(batch) and len(out := found(own, batch)):
                yield out

    return images.where("image is not null").select("frame_id", "image.height", "image.width", "image.data").mapInPandas(run, _DETECTED)
