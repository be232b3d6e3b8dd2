"""Fill-in-middle: the compressed set against plain lists, the query against its SQL and a line-by-line version."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import middles
from framelake.llm.sql import ORACLE_SQL


def ends_of(data: bytes) -> list[int]:
    return [m.end() - 1 for m in re.finditer(rb"[^\n]*\n|[^\n]+", data)]


def check(data: bytes) -> middles.Positions:
    held, want = middles.line_ends(np.frombuffer(data, np.uint8)), ends_of(data)
    assert len(held) == len(want)
    step = max(1, len(want) // 500)
    assert [middles.select(held, i) for i in range(0, len(want), step)] == want[::step]
    return held


def test_each_container_kind():
    rng = random.Random(1)
    sparse = b"x" * 1000 + b"\n" + b"y" * 70_000 + b"\n" + b"z"
    dense = bytes(rng.choice(b"a\n") for _ in range(300_000))
    runs = (b"\n" * 900 + b"abc") * 400
    kinds = [[k for k, _ in check(d).containers] for d in (sparse, dense, runs, b"\n" * 65_536 + b"a" * 65_536 + b"\n")]
    assert kinds[0] == ["array", "array"] and set(kinds[1]) == {"bitmap"} and set(kinds[2]) == {"run"} and kinds[3] == ["run", "array"]
    assert middles.line_ends(np.frombuffer(dense, np.uint8)).containers[0][1].nbytes == 8192


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3))
def test_select_is_the_sorted_list(data, shift):
    check(b"\n" * (shift * 30_000) + data.replace(b"\xff", b"\n"))


def by_lines(doc_id, text):
    x = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", x)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not x or any(m in x for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, len(lines), "plain", None, None, sha(x), sha(x)
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 50 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(lines), "spm" if h4 % 100 < 50 else "psm", len(prefix), len(middle), sha(out), sha(x)


def test_query_is_its_sql_and_lines(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    line = lambda: "".join(rng.choices("abé日𝄞<SMP> \r\t\v ", k=rng.randint(0, 12)))
    texts = ["\n".join(line() for _ in range(rng.randint(0, 15))) for _ in range(200)]
    texts += [None, "", "\n", "\n\n\n", "a", "a\n", "x<P>y\nz", "<S", "a<\n<\nS>\nb", "<" * 9 + "\n" + ">S<P\n<M", "w\n" * 300_000, "é" * 200_000, texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "p\nq\nr"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    key = lambda r: tuple(map(str, r))
    want = sorted((by_lines(*r) for r in rows), key=key)
    got = sorted((tuple(r) for r in middles.rearranged_documents(docs.repartition(3)).collect()), key=key)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted(con.execute(ORACLE_SQL["op11_rearranged_documents"]).fetchall(), key=key) == want


def test_outputs_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5), (2, None, None)], "doc_id long, text string, n long").withColumns({c: F.lit("clash") for c in ("row", "form", "output", "draws")})
    rows = {r["row"]["doc_id"]: r for r in middles.rearranged(docs, keep=("doc_id", "n", "output"), rate=100, spm_rate=0).collect()}
    assert rows[1]["form"] == "psm" and rows[1]["row"]["n"] == 5 and rows[1]["row"]["output"] == "clash" and rows[1]["output"].startswith("<P>") and rows[2]["output"] == ""
    assert [r["form"] for r in middles.rearranged(docs, rate=0).collect()] == ["plain"] * 2
    assert middles.rearranged_documents(docs.limit(0)).count() == 0
    assert middles.rearranged_documents(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
