"""Bands of perplexity: planted documents on either side, clean ones inside."""

import numpy as np

from framelake.llm import perplexity


def test_planted_documents_are_outside_the_bands(spark):
    rng = np.random.default_rng(21)
    n_bytes = rng.integers(300, 3000, 400)
    bits = 1.5 + 0.02 * np.clip(rng.standard_normal(400), -2, 2)  # spread doesn't depend on length
    q1, q3 = np.quantile(bits, [0.25, 0.75])
    away = 2.5 * (q3 - q1)
    rows = [(i, "en", False, float(b), int(n)) for i, (b, n) in enumerate(zip(bits, n_bytes, strict=True))]
    rows += [(400, "en", False, float(q1 - away), 1500), (401, "en", False, float(q3 + away), 1500), (402, None, False, 9.0, 1500), (403, "en", True, None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, bits double, n_bytes long")
    got = {r["doc_id"]: r for r in perplexity.banded(table, "bits", "n_bytes", perplexity.FENCES).collect()}
    assert len(got) == len(rows) and got[400]["bits"] < got[400]["lower"] and got[401]["bits"] > got[401]["upper"]
    assert sum(got[i]["lower"] <= got[i]["bits"] <= got[i]["upper"] for i in range(400)) == 400
    assert got[402]["lower"] <= 9.0 <= got[402]["upper"]
    # length that explains nothing widens little
    assert max(got[i]["upper"] for i in range(400)) < q3 + 2.5 * (q3 - q1)
