"""What the stages of the pipeline decide, against plain Python over the same rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from framelake.llm import crf, pieces

SYLLABLES = ("ka", "lo", "mi", "ter", "un", "re", "son", "ti")


def text(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def documents(spark, tmp_path):
    rng = random.Random(51)
    rows = []
    for i in range(240):
        good = text(rng, 60).capitalize() + ".\n" + text(rng, 40) + "."
        body = good if i % 3 else "\n".join(" ".join(w + rng.choice(["###", "$$$"]) for w in line.split()) for line in good.split("\n"))
        rows.append((i, body, "en", f"s{i % 4}", len(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return {r[0]: r for r in rows}, docs


def test_quality_drops_what_the_model_rejects(spark, tmp_path):
    rows, docs = documents(spark, tmp_path)
    kept = {r["doc_id"]: tuple(r) for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    model = crf.fit_quality(docs, crf.taught(labels.selectExpr("doc_id", "quality as label")))
    scores = crf.text_scores(pa.array([rows[i][1] for i in sorted(rows)]), model)
    assert set(kept) == {i for i, s in zip(sorted(rows), scores, strict=True) if s >= corpus_pipeline.LEAST_QUALITY}
    assert all(kept[i] == rows[i] for i in kept) and np.mean([i in kept for i in rows if i % 3]) > 0.97 > 0.05 > np.mean([i in kept for i in rows if i % 3 == 0])


def test_encoding_gives_back_every_text(spark, tmp_path):
    rows, docs = documents(spark, tmp_path)
    model = pieces.load_model()
    got = corpus_pipeline.encoding(spark, docs, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = np.array(r["token_ids"], np.int32)
        own = rows[r["doc_id"]]
        assert pieces.decode(ids, np.array([0, len(ids)]), model) == [own[1]] and r["n_tokens"] == len(ids) and (r["lang"], r["source"]) == own[2:4]
        assert r["text_sha256"] == hashlib.sha256(own[1].encode()).hexdigest()


def test_whole_pipeline(spark, tmp_path):
    rows, _ = documents(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {i for i in rows} and len({r["doc_id"] for r in got}) > 150
    assert not {r["doc_id"] for r in got if r["doc_id"] % 3 == 0 and r["doc_id"] % 2 == 0} - set(range(0, 240, 30))
