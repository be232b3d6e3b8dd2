"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import crf, langid, minhash, mixing, perplexity, pieces, secrets, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "score", "label", "shard", "place", "base", "spans", "tokens", "weight", "held_out", "component_id", "fingerprint", "block", "grp", "n")


def words(seed, n, syllables="ka lo mi ter und re son ti va el".split()):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


ROWS = [
    (0, words(1, 80) + ".\n" + words(2, 60), "en", "a", 1),
    (1, words(1, 80) + ".\n" + words(2, 60), "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "de", "b", 0),
    (4, " \n\t ", "de", "b", 4),
    (5, words(5, 40_000), "de", "b", 1),
    (6, "Zeile ¡ñandú! " + words(6, 55), "es", None, 1),
    (8, words(8, 70) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + words(9, 20), "en", "a", 1),
    (8, words(8, 70) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + words(9, 20), "en", "a", 1),
    (None, words(10, 60), "en", "a", 1),
    (9, "x" * 3000, "en", "a", 3000),
    (10, "1234567890123456 +++", "en", "c", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 1, 1), (3, 0, None), (4, None, 0), (5, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, _: secrets.scanned_documents(d),
    "minhash": lambda d, _: minhash.document_fingerprints(d),
    "crf": lambda d, x: crf.document_quality(d, x),
    "sharding": lambda d, _: sharding.balanced_shards(d),
    "langid": lambda d, _: langid.predicted_languages(d),
    "mixing": lambda d, _: mixing.mixed_documents(d),
    "pieces": lambda d, _: pieces.encoded_documents(d),
    "simhash": lambda d, _: simhash.simhash_components(d),
    "toxicity": lambda d, x: toxicity.document_toxicity(d, x),
    "perplexity": lambda d, _: perplexity.rule_verdicts(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twins = [tuple(v for k, v in r.asDict().items() if k not in ("shard", "slot", "near_next", "edited_sha256", "edited_fingerprint", "near_edited")) for r in rows if r["doc_id"] == 8]
    assert twins[0] == twins[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", ["crf", "toxicity"])
def test_without_labels(docs, labels, name):
    assert {r["score"] for r in OPERATORS[name](docs, labels.limit(0)).collect()} == {0.5 if name == "crf" else 0.0}


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage[1](spark, docs, str(tmp_path))
    rows = out.collect()
    assert rows and (stage[0] == "encoding" or out.columns == docs.columns)
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_decide(spark, docs, labels, tmp_path):
    near = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert 0 in near and 1 not in near and {2, 5, 6, 8, 9, 10, None} <= near | {2, 3, 4}
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert "[secret]" in masked[8] and "04dbebab" not in masked[8] and masked[0] == ROWS[0][1]
    drawn = [r["doc_id"] for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    assert {r[0] for r in ROWS} == set(drawn)
