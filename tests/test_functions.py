"""Column functions on small examples."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import columns as C
from framelake.functions.ranking import best_object, dominance, structure
from framelake.operators.embedding import hash_embedding, safely, sparse_embedding

OBJECT = "struct<label:string,confidence:double,bbox:array<double>,area:double,color_hex:string,color_name:string,size:string>"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


def objects(*triples):
    return F.array(*[F.struct(F.lit(a).alias("label"), F.lit(0.9).alias("confidence"), F.array(F.lit(0.0)).alias("bbox"), F.lit(1.0).alias("area"), F.lit("#000").alias("color_hex"), F.lit(b).alias("color_name"), F.lit(c).alias("size")) for a, b, c in triples])


@pytest.mark.parametrize(("side", "expected"), [(10, "tiny"), (20, "small"), (40, "medium"), (50, "large"), (70, "huge")])
def test_size_class(spark, side, expected):
    box = F.array(*[F.lit(float(x)) for x in (0, 0, side, side)])
    assert one(spark, C.size_class(box, F.lit(10_000.0))) == expected


def test_size_of_inverted_or_unknown(spark):
    box = F.array(*[F.lit(float(x)) for x in (10, 20, 5, 5)])
    assert one(spark, C.box_area(box)) == 0
    assert one(spark, C.size_class(box, F.lit(10_000.0))) == "tiny"
    assert one(spark, C.size_class(F.array(*[F.lit(float(x)) for x in (0, 0, 90, 90)]), F.lit(0.0))) == "tiny"


def test_build_tags(spark):
    tags = one(spark, C.build_tags(objects(("car", "red", "large"), ("truck", "unknown", "small"), ("truck", "blue", "huge"), (None, "red", "huge"))))
    assert tags == ["blue truck", "car", "huge truck", "large car", "red car", "truck"]


@pytest.mark.parametrize(("seconds", "text"), [(125.0, "02:05"), (0.0, "00:00"), (6000.9, "100:00")])
def test_clip_clock(spark, seconds, text):
    assert one(spark, C.clip_clock(F.lit(seconds))) == text


def test_wall_clock(spark):
    assert one(spark, C.wall_clock(F.lit(None).cast("double"))) == "" == one(spark, C.wall_clock(F.lit(0.0)))
    assert one(spark, C.wall_clock(F.lit(86_399.5))) == "1970-01-01 23:59:59"


@pytest.mark.parametrize(("text", "expected"), [("1500", 1500.0), ("1500.5", 1500.5), ("20260912", 20260912.0), ("1970-01-02T00:00:00", 86400.0), ("1970-01-02 00:00:01", 86401.0), ("not-a-time", None), ("", None), ("2026-09", None), (".", None)])
def test_parse_time(spark, text, expected):
    assert one(spark, C.parse_time(F.lit(text))) == expected


@pytest.mark.parametrize(("path", "expected"), [("/a/cam_1757700000.mp4", 1757700000.0), ("/a/1757700000123.mp4", 1757700000.0), ("/1757700000/x.mp4", 7.0), ("/a/12345.mp4", 7.0)])
def test_derive_wall_time(spark, path, expected):
    assert one(spark, C.derive_wall_time(F.lit(path), F.lit(7.0))) == expected


def test_token_features(spark):
    assert one(spark, C.token_features(F.lit("Red ox, red!"))) == ["$red", "re", "ed", "$ox", "$red", "re", "ed"]


def test_bucket_is_the_digests(spark):
    for f in ("$red", "re", "$automobile"):
        assert one(spark, C.feature_bucket(F.lit(f))) == int.from_bytes(hashlib.md5(f.encode()).digest()[:4], "big") % 512


def test_hash_embedding_dense_is_sparse(spark):
    dense = hash_embedding(["hello world", "test", "42"])
    assert dense.shape == (3, 512) and np.allclose(np.linalg.norm(dense, axis=1), [1, 1, 0])
    rows = sparse_embedding(spark.createDataFrame([("a", "hello world")], "k string, t string"), "k", "t").collect()
    assert {r["bucket"] for r in rows} == set(np.flatnonzero(dense[0]).tolist())
    assert all(math.isclose(r["weight"], dense[0][r["bucket"]], rel_tol=1e-6) for r in rows)


def test_failing_encoder_falls_back():
    def broken(texts):
        raise RuntimeError("no model")

    assert np.allclose(safely(broken, ["red car"])[0], hash_embedding(["red car"])[0])


@pytest.mark.parametrize(("a", "b", "expected"), [([1.0, 0, 0], [1.0, 0, 0], 1.0), ([1.0, 0], [0, 1.0], 0.0), ([], [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)])
def test_cosine(spark, a, b, expected):
    vector = lambda v: F.array(*[F.lit(float(x)) for x in v]).cast("array<float>")
    assert one(spark, C.cosine(vector(a), vector(b))) == pytest.approx(expected)


def test_parse_query(spark):
    q = one(spark, C.parse_query(F.lit("a big red automobile and two blue bicycles, orange bikes")))
    assert (q["labels"], q["colors"], q["sizes"]) == (["bicycle", "car", "motorcycle"], ["blue", "orange", "red"], ["large"])


def test_structure_needs_one_object_with_all(spark):
    q = C.parse_query(F.lit("gray truck"))
    whole, split = objects(("truck", "gray", "small")), objects(("car", "gray", "small"), ("truck", "purple", "small"))
    row = spark.range(1).select(q.alias("q"), whole.alias("w"), split.alias("s")).select(structure(best_object(F.col("w"), F.col("q")), F.col("q")), structure(best_object(F.col("s"), F.col("q")), F.col("q"))).first()
    assert tuple(row) == (1.0, 0.5)


def test_dominance(spark):
    q = C.parse_query(F.lit("car"))
    row = spark.range(1).select(q.alias("q"), objects(*[("car", "red", "small")] * 3).alias("o"), objects(("dog", "red", "small")).alias("n")).select(dominance(F.col("o"), F.col("q")), dominance(F.col("n"), F.col("q"))).first()
    assert row[0] == pytest.approx(math.log1p(3) / math.log1p(4)) and row[1] == 0
