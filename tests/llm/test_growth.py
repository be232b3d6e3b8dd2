"""What must hold as tables and texts grow: shards, passes over a large model, words without spaces."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import perplexity, pieces, simhash


def test_shards_stay_small_as_the_table_grows():
    rng = np.random.default_rng(3)
    largest = []
    for n in (20_000, 80_000):
        points = rng.integers(0, 1 << 63, n, np.int64).view(np.uint64)
        sample = points[:: max(1, n // max(500, n // 10))]  # as with SAMPLE = 500 and SAMPLED = 10
        mask = simhash.masks(simhash.blocks_for(4))[0]
        tree = simhash.grown_tree(sample, mask, 1, n / len(sample), 600)
        largest.append(max(len(at) for _, at in simhash.routed(points, tree, mask, 1)))
    assert largest[1] < 1.6 * largest[0] < 8000


def test_the_sample_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 100)
    monkeypatch.setattr(simhash, "SAMPLED", 4)
    seen = []
    whole = simhash.grown_tree
    monkeypatch.setattr(simhash, "grown_tree", lambda sample, *a: (seen.append(len(sample)), whole(sample, *a))[1])
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 62), 1 << 62, 8000)], "point long")
    simhash.near_fingerprints(points).collect()
    assert min(seen) > 1500


@pytest.mark.parametrize("piece", [10**9, 4000, 700])
def test_passes_add_up_and_read_null_and_nul_apart(spark, piece):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdeü", k=rng.randint(1, 6))) for _ in range(n))
    rows = [(i, text(rng.randint(50, 90)), "en") for i in range(60)]
    rows += [rows[3], rows[3], (70, None, "en"), (70, "\0", "en"), (70, "", "en"), (70, None, "en"), (None, rows[4][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["word_chars"], str(r["perplexity"])[:9])
    want = sorted(perplexity.rule_verdicts(docs, piece=10**9).collect(), key=key)
    got = sorted(perplexity.rule_verdicts(docs.repartition(3), piece=piece).collect(), key=key)
    assert [(r["doc_id"], r["n_words"], r["word_chars"], r["base_failed"], r["kept"]) for r in got] == [(r["doc_id"], r["n_words"], r["word_chars"], r["base_failed"], r["kept"]) for r in want]
    assert all((a["perplexity"] is None) == (b["perplexity"] is None) and (a["perplexity"] is None or abs(a["perplexity"] - b["perplexity"]) < 1e-9) for a, b in zip(got, want, strict=True))
    assert len(got) == len(rows)


def test_halves_in_spark_are_those_in_tasks(spark):
    texts = ["", "a", "é" * 9, "x y z", "\0", None]
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    half = F.shiftright(F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 7).bitwiseAND(F.lit(1))
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1).orderBy("i").select(half).collect()]
    assert got == perplexity.halves(data, at).tolist()


def test_long_words_are_searched_in_parts():
    model = pieces.load_model()
    rng = random.Random(6)
    signs = "日本語中文字的是不了在人有我他这個們来到時大地為子" + "กขคงจ" + "qxzjvk"
    text = "".join(rng.choices(signs, k=500_000))
    began = time.time()
    ids, at = pieces.encode([text, "end"], model)
    assert time.time() - began < 20 and pieces.decode(ids, at, model) == [text, "end"]
    words = ["".join(rng.choices("abcдеж日 ", k=rng.randint(1, 40))) for _ in range(300)]
    apart = [pieces.encode([w], model)[0].tolist() for w in words]
    ids, at = pieces.encode(words, model)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == apart
