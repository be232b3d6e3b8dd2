"""Archives: header lines of both versions, damage, conversion, and the query against its SQL."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from framelake.llm import archives as W
from framelake.llm.sql import ORACLE_SQL

V1 = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
V2_BLOCK = b"2 0 Origin\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = b"filedesc://new.arc 0.0.0.0 20010501000000 text/plain 200 - - 0 new.arc %d\n" % len(V2_BLOCK) + V2_BLOCK + b"\n"


def message(payload, *more):
    return b"\r\n".join([b"HTTP/1.0 200 OK", b"Content-Type: text/html", *more, b"Content-Length: %d" % len(payload), b"", payload])


def v1(url, date, block, mime=b"text/html"):
    return b" ".join([url, b"1.2.3.4", date, mime, b"%d" % len(block)]) + b"\n" + block + b"\n"


def v2(url, date, block):
    return b" ".join([url, b"1.2.3.4", date, b"text/html", b"200", b"abc", b"-", b"99", b"new.arc", b"%d" % len(block)]) + b"\n" + block + b"\n"


def test_header_lines_of_both_versions():
    tricky = b"line\nhttp://x/ 1.1.1.1 20000101000000 text/html 3\nabc\n\n"
    got = [list(W.arc_parts(io.BytesIO(d))) for d in (V1 + v1(b"http://a/with space", b"199609231421", message(tricky)) + v1(b"dns:a", b"19960923142103", b"a 1.2.3.4", b"text/dns"), V2 + v2(b"http://b/", b"20010501123456", message(b"")))]
    assert [f["URL"] for f, _ in got[0]] == ["filedesc://old.arc", "http://a/with space", "dns:a"] and got[0][1][1] == message(tricky)
    assert got[1][1][0]["Filename"] == "new.arc" and got[1][1][0]["Archive-length"] == str(len(message(b""))) and got[1][0][1] == V2_BLOCK


def test_damage_is_passed_over():
    cut = V1 + v1(b"http://a/", b"20000101000000", b"x" * 50) + b"http://b/ 1.1.1.1 2000 text/html 5000\nshort"
    assert [f["URL"] for f, _ in W.arc_parts(io.BytesIO(cut))] == ["filedesc://old.arc", "http://a/"]
    odd = V1 + b"no header\n" + v1(b"http://a/", b"20000101000000", b"x") + b"http://c/ 1.1.1.1 2000 text/html many\n" + v1(b"http://b/", b"20000101000000", b"y")
    assert [b for _, b in W.arc_parts(io.BytesIO(odd))][1:] == [b"x", b"y"]
    assert list(W.arc_parts(io.BytesIO(b""))) == [] and list(W.warc_parts(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))) == []


@pytest.mark.parametrize(("digits", "iso"), [("19960923142103", "1996-09-23T14:21:03Z"), ("199609231421", "1996-09-23T14:21:00Z"), ("19960923", "1996-09-23T00:00:00Z"), ("1996", "1996-01-01T00:00:00Z"), ("19961399000000", "1970-01-01T00:00:00Z"), ("soon", "1970-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z")])
def test_times(digits, iso):
    assert W.iso_time(digits) == iso


def test_http_parts_and_fields():
    assert W.http_parts(b"HTTP/1.1 200 OK\nA: b\n\nx\r\n\r\ny") == (b"HTTP/1.1 200 OK\nA: b\n\n", b"x\r\n\r\ny") and W.http_parts(b"plain") == (b"", b"plain")
    assert W.http_parts(b"HTTP/1.1 200 OK\r\n") == (b"HTTP/1.1 200 OK\r\n", b"") and W.field(b"a: 1\r\nx-page-ID:  7 \r\n", b"X-Page-Id") == "7"


def test_conversion_of_foreign_files(spark, tmp_path):
    same = b"<p>" + b"same " * 40
    (tmp_path / "in").mkdir()
    page = lambda i, p: message(p, b"X-Page-Id: %d" % i)
    old = [V1, v1(b"http://a/", b"19960923142103", page(5, same)), v1(b"http://none/", b"19960923142103", message(same)), v1(b"dns:a", b"19960923142103", b"a 1.2.3.4", b"text/dns")]
    (tmp_path / "in/old.arc.gz").write_bytes(b"".join(gzip.compress(r) for r in old))  # a member a record
    (tmp_path / "in/new.arc").write_bytes(V2 + v2(b"http://b/", b"20010501123456", page(2, same)) + v2(b"http://c/", b"20010501123456", page(9, same)) + v2(b"http://d/", b"20010501123456", page(1, b"small")))
    W.convert_arc(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = W.read_warc(spark, str(tmp_path / "out"), bodies=True).collect()
    kinds = {(r["uri"], r["record_type"], r["refers_to"]) for r in rows}
    assert kinds == {(None, "warcinfo", None), ("http://a/", "revisit", "2"), ("http://b/", "response", None), ("http://c/", "revisit", "2"), ("http://d/", "response", None), ("http://none/", "response", None), ("dns:a", "resource", None)}
    by = {r["uri"]: r for r in rows}
    assert all(r["intact"] for r in rows) and len({r["record_id"] for r in rows}) == len(rows) and by["http://a/"]["refers_to_id"] == by["http://b/"]["record_id"]
    assert by["http://a/"]["date"] == "1996-09-23T14:21:03Z" and by["http://a/"]["payload_bytes"] == len(same) and by["http://a/"]["payload"] == b"" and by["http://b/"]["payload"] == same
    assert by["dns:a"]["payload"] == b"a 1.2.3.4"
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz"))
    assert raw.count(b"\r\n\r\nWARC/1.1\r\n") + 1 == len(rows) and b"WARC-Profile: " + W.PROFILE.encode() in raw


def rows_of():
    rng = random.Random(4)
    body = lambda n: "".join(rng.choices("<p>é日\r\n WARC/1.1\0", k=n))
    shared, hot = [body(rng.randint(60, 300)) for _ in range(10)], body(500)
    rows = [(i, f"http://h/{i} x", rng.choice([hot, rng.choice(shared), body(rng.randint(0, 200))])) for i in range(400, 100, -1)]
    edge = "e" * 99
    rows += [(7, None, None), (8, "", ""), (9, "u\nv", None), (10, "http://é/", edge), (11, "x", edge), (12, "x", edge + "é"), (13, "x", edge + "é"), (101, "again", rows[-1][2]), (14, "x", "big" * 2_000_000)]
    return rows


@pytest.mark.parametrize("hot_rows", [20, W.HOT_ROWS])
def test_query_is_its_sql(spark, tmp_path, monkeypatch, hot_rows):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(W, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(W, "FLUSH", 3000)
    rows = rows_of()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages/*.parquet')")
    want = sorted(con.execute(ORACLE_SQL["op12_converted_pages"]).fetchall(), key=str)
    clash = pages.repartition(5).withColumns({c: F.lit("x") for c in ("first", "kind", "payload", "n", "body", "value", "content")})
    got = sorted((tuple(r) for r in W.converted_pages(clash).collect()), key=str)
    assert got == want and len(got) == len(rows) and sum(r[3] == "revisit" for r in got) > 100
    digests = {r[0]: r[2] for r in got}
    assert all(digests[i] == hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows)


def test_pages_without_ids_and_empty_tables(spark):
    rows = [(None, "a", "x" * 200), (None, "b", "x" * 200), (5, "c", "x" * 200), (3, "d", "x" * 200), (3, "d", "x" * 200)]
    got = W.converted_pages(spark.createDataFrame(rows, "page_id int, url string, html string"))
    assert got.schema["page_id"].dataType.simpleString() == "int"
    assert sorted(map(str, ((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()))) == sorted(map(str, [(None, "response", None), (None, "response", None), (3, "response", None), (3, "response", None), (5, "revisit", 3)]))
    assert W.converted_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
