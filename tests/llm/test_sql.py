"""SQL of the training-data queries, on planted cases."""

import random
import string

import pytest

from framelake.llm.mixing import mixed_documents
from framelake.llm.secrets import scanned_documents
from framelake.llm.sql import ORACLE_SQL


def test_secret_scan_is_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    token = lambda n, signs: "".join(rng.choices(signs, k=n))
    texts = [f"é {token(rng.randint(18, 150), s)} and {token(40, s)}==" for s in (string.ascii_letters + string.digits, "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits + "+/", string.ascii_lowercase, "ab", string.digits) for _ in range(12)]
    texts += [f'key = x; Token: "{token(30, string.hexdigits)}" AKIA{token(16, string.ascii_uppercase)}', None, "", "a" * 200, "CamelCaseIdentifierNamesAreNotSecretsAtAll" * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    want = con.execute(ORACLE_SQL["op1_scanned_documents"]).df().sort_values("doc_id")
    got = scanned_documents(docs).toPandas().sort_values("doc_id")[list(want.columns)]
    assert want["n_random"].sum() > 40 and want["n_random"][12 * 4 : 12 * 7].sum() == 0
    assert [tuple(map(str, r)) for r in got.itertuples(index=False)] == [tuple(map(str, r)) for r in want.itertuples(index=False)]


def test_mixture_is_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    rows = [(i, None if i % 97 == 0 else " ".join(["wort"] * rng.randint(0, 30)), s) for i, s in enumerate(["big"] * 700 + ["mid"] * 150 + ["low"] * 50 + [None] * 50 + ["empty"])]
    rows[-1] = (rows[-1][0], "", "empty")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    want = con.execute(ORACLE_SQL["op6_mixed_documents"]).df().sort_values("doc_id")
    got = mixed_documents(docs).toPandas().sort_values("doc_id")[list(want.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.8g}" if isinstance(v, float) else str(v)
    assert 0 < want["exponent"].iloc[0] < 1 and want["n_copies"].max() > 1
    assert [tuple(map(text, r)) for r in got.itertuples(index=False)] == [tuple(map(text, r)) for r in want.itertuples(index=False)]
