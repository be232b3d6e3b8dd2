"""Legacy crawl archives (ARC) and their conversion to WARC.

Files hold gzip text: Spark's text writer gives a file to each partition, so they are as large as the splits that are read
(`spark.sql.files.maxPartitionBytes`). A reader unpacks a file as a stream and goes from record to record by declared
lengths, holding one record and FLUSH bytes of finished ones beside the packed file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.storage import removed_at_end, shared_path, written

#: Payloads under so many bytes are always stored whole.
LEAST_SHARED = 100
#: Groups of equal payloads that are sent to every task: the largest ones, of HOT_ROWS or more records.
HOT_GROUPS, HOT_ROWS = 10_000, 1_000
FLUSH = 4_000_000
# Fields of a record's header line by version of the format, and the profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_FASTEST = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def flushed(rows: Iterator[tuple[int, tuple]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows, given with their sizes, as batches of about FLUSH bytes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= FLUSH:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", body_col: str = "html", captured: str = "20200101000000", version: int | None = None) -> None:
    """An ARC record for each page, an HTTP response that names the page; null pages are empty.

    Files are of the given version of the format, by default of version 1 and 2 in turn. A missing address is "-"; its white space is escaped.
    """

    def records(batches: Iterator[pa.RecordBatch], own: int, name: bytes) -> Iterator[tuple[int, tuple]]:
        offset = 0

        def record(url: bytes, mime: bytes, status: bytes, body: bytes) -> tuple[int, tuple]:
            nonlocal offset
            more = [] if own == 1 else [status, b"-", b"-", b"%d" % offset, name]
            line = b" ".join([url, b"0.0.0.0", captured.encode(), mime, *more, b"%d" % len(body)])
            offset += len(line) + len(body) + 2
            return len(body), (line + b"\n" + body,)

        for batch in batches:
            for key, url, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not offset:
                    yield record(b"filedesc://" + name, b"text/plain", b"200", f"{own} 0 framelake\n{ARC_FIELDS[own]}\n".encode())
                named = b"" if key is None else b"X-Page-Id: " + _UNSAFE.sub(b"", key) + b"\r\n"
                body = body or b""
                yield record(_UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url or b"-"), b"text/html", b"200", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + b"Content-Length: %d\r\n\r\n" % len(body) + body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for out in flushed(records(batches, version or 1 + task % 2, b"part-%05d.arc" % task), ["value"], [pa.binary()]):
            yield pa.record_batch([out.column(0).view(pa.string())], ["value"])

    rows = pages.select(F.col(key_col).cast("string").cast("binary").alias("key"), F.col(url_col).cast("binary").alias("url"), F.col(body_col).cast("binary").alias("body"))
    rows.mapInArrow(run, "value string").write.options(lineSep="\n", **_FASTEST).text(path)


def opened(content: bytes) -> BinaryIO:
    """A stream over a file's bytes, unpacked where they are gzip (of one member or many)."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_parts(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by name, and block, of each record of an ARC file; the fields are those that its version block says.

    A line that is no header (too few fields, no number for a length) is passed over, so reading goes on after a damaged
    record. A record that ends before its length is dropped.
    """
    fields = ARC_FIELDS[1].split()
    while line := stream.readline():
        values = line.rstrip(b"\r\n").rsplit(b" ", len(fields) - 1)  # only an address may hold spaces
        first = line.startswith(b"filedesc://")
        if first:
            values = line.rstrip(b"\r\n").split(b" ")
            fields = next((f.split() for f in ARC_FIELDS.values() if len(f.split()) == len(values)), fields)
        if len(values) != len(fields) or not values[-1].isdigit():
            continue
        block = stream.read(size := int(values[-1]))
        if len(block) < size:
            return
        yield dict(zip(fields, (v.decode("utf-8", "replace") for v in values), strict=True)), block
        if first:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(m[0]) if lines and (m := re.match(r"\d+", lines[0])) else 1
            fields = lines[1].split() if len(lines) > 1 and lines[1].startswith("URL ") else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()


def iso_time(digits: str) -> str:
    """An ARC time (of 14 digits, or fewer from the year on) as a WARC date; what is no time is the epoch's start."""
    whole = digits + "00000101000000"[len(digits) :] if digits.isdigit() and 4 <= len(digits) <= 14 else "19700101000000"
    y, mo, d, h, mi, s = whole[:4], *(whole[i : i + 2] for i in range(4, 14, 2))
    fits = "01" <= mo <= "12" and "01" <= d <= "31" and h <= "23" and mi <= "59" and s <= "60"
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z" if fits else "1970-01-01T00:00:00Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; another block is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    cut = sum(min(ends)) if ends else len(block)
    return block[:cut], block[cut:]


def field(head: bytes, name: bytes) -> str | None:
    """The value of a header field, whatever the case of its name."""
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _read(spark: SparkSession, path: str, parse: Callable[[str, BinaryIO], Iterator[tuple[int, tuple]]], schema: str) -> DataFrame:
    """Rows that `parse` finds in the files of a folder; a file that can't be unpacked further ends there."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            for i in range(len(batch)):
                try:
                    yield from parse(batch.column(0)[i].as_py().rsplit("/", 1)[-1], opened(batch.column(1)[i].as_py()))
                except (EOFError, OSError, zlib.error):
                    continue

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lambda b: flushed(rows(b), list(names), [kinds[t] for t in types]), schema)


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of ARC files of either version: (file, number, kind, uri, ip, date, mime, page_id, payload_bytes, payload_digest, block_digest, head, payload).

    kind is info for a file's version block, http for HTTP responses, else other. Digests are SHA-256 in hex; date is a WARC date.
    page_id is the message's own field, else null. Without bodies head and payload are null.
    """

    def parse(name: str, stream: BinaryIO) -> Iterator[tuple[int, tuple]]:
        for number, (fields, block) in enumerate(arc_parts(stream)):
            head, payload = http_parts(block)
            kind = "info" if fields["URL"].startswith("filedesc:") else "http" if head else "other"
            facts = (name, number, kind, fields["URL"], fields["IP-address"], iso_time(fields["Archive-date"]), fields["Content-type"], field(head, b"X-Page-Id"), len(payload), _sha(payload), _sha(block))
            yield (len(block) if bodies else 200), (*facts, *((head, payload) if bodies else (None, None)))

    schema = "file string, number long, kind string, uri string, ip string, date string, mime string, page_id string, payload_bytes long, payload_digest string, block_digest string, head binary, payload binary"
    return _read(spark, path, parse, schema)


def record_id(*parts: Column) -> Column:
    """A record's identifier, always the same for the same file and number."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def shared_payloads(facts: DataFrame) -> DataFrame:
    """(payload_digest, first, n): payloads of LEAST_SHARED bytes or more that several records have, with the record of the smallest page_id."""
    own = facts.where((F.col("kind") == "http") & (F.col("payload_bytes") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    groups = own.groupBy("payload_digest").agg(F.min(F.struct("page_id", "file", "number", "uri", "date")).alias("first"), F.count("*").alias("n"))
    return groups.where("n > 1")


def with_first(records: DataFrame, groups: DataFrame) -> DataFrame:
    """records with `first` of their payload's group, null without one.

    The largest groups, at most HOT_GROUPS, go to every task; the others are joined by digest, each of them a small share of all records.
    """
    hot = groups.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "payload_digest").limit(HOT_GROUPS)
    rows = records.join(F.broadcast(hot.select("payload_digest", F.col("first").alias("_hot"))), "payload_digest", "left")
    alone = F.col("_hot").isNotNull() | (F.col("payload_bytes") < LEAST_SHARED) | F.col("page_id").isNull()
    rows = rows.withColumn("_key", F.when(alone, F.concat_ws("|", "file", "number")).otherwise(F.col("payload_digest")))
    rows = rows.join(groups.select(F.col("payload_digest").alias("_key"), F.col("first").alias("_own")), "_key", "left")
    return rows.withColumn("first", F.coalesce("_hot", "_own")).drop("_key", "_hot", "_own")


def warc_text(records: DataFrame) -> Column:
    """The WARC record of each row of read_arc with `first`: warcinfo for a version block, response or revisit for HTTP, else resource."""
    revisit = F.col("page_id") > F.col("first.page_id")
    kind = F.when(F.col("kind") == "info", "warcinfo").when(F.col("kind") == "other", "resource").when(revisit, "revisit").otherwise("response")
    block_digest = F.when(kind == "revisit", F.sha2("head", 256)).otherwise(F.col("block_digest"))
    size = F.octet_length("head") + F.when(kind == "revisit", 0).otherwise(F.octet_length("payload"))
    is_http, first = kind.isin("response", "revisit"), F.when(kind == "revisit", F.col("first.page_id"))
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(F.col("file"), F.col("number").cast("string"))), ("WARC-Warcinfo-ID", F.when(kind != "warcinfo", record_id(F.col("file"), F.lit("0")))), ("WARC-Date", F.col("date")),
        ("WARC-Filename", F.when(kind == "warcinfo", F.col("file"))), ("WARC-Target-URI", F.when(kind != "warcinfo", F.col("uri"))), ("WARC-IP-Address", F.when(is_http, F.col("ip"))),
        ("WARC-Payload-Digest", F.when(is_http, F.concat(F.lit("sha256:"), "payload_digest"))), ("WARC-Block-Digest", F.concat(F.lit("sha256:"), block_digest)), ("WARC-Profile", F.when(kind == "revisit", PROFILE)),
        ("WARC-Refers-To", F.when(first.isNotNull(), record_id(F.col("first.file"), F.col("first.number").cast("string")))), ("WARC-Refers-To-Target-URI", F.when(first.isNotNull(), F.col("first.uri"))),
        ("WARC-Refers-To-Date", F.when(first.isNotNull(), F.col("first.date"))), ("X-Refers-To-Page", first.cast("string")), ("Content-Type", F.when(is_http, "application/http; msgtype=response").otherwise(F.col("mime"))), ("Content-Length", size.cast("string")),
    ]
    head = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in lines]
    return F.concat_ws("", F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), F.col("head").cast("string"), F.when(kind != "revisit", F.col("payload").cast("string")))


def convert_arc(spark: SparkSession, source: str, target: str, key_type: str = "long") -> None:
    """WARC files for all records of a folder of ARC files, whatever their versions.

    Identifiers come from file and number, dates from the ARC times, types from the kind of record, digests from the bytes. Of HTTP
    records with equal payloads of LEAST_SHARED bytes or more that with the smallest page_id is stored whole (with equal ids each of them), others as
    revisits to it; records without a page_id are stored whole.
    """
    typed = lambda bodies: read_arc(spark, source, bodies).withColumn("page_id", F.col("page_id").try_cast(key_type))
    records = with_first(typed(True), written(shared_payloads(typed(False)), "shared-payloads"))
    records.select(warc_text(records).alias("value")).write.options(lineSep="\r\n\r\n", **_FASTEST).text(target)


def warc_parts(stream: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of a WARC file, by declared lengths; a record that ends early is dropped."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = bytearray()
        while (line := stream.readline()).strip():
            head += line
        size = field(bytes(head), b"Content-Length")
        block = stream.read(int(size)) if size and size.isdigit() else b""
        if size and size.isdigit() and len(block) == int(size):
            yield bytes(head), block


def read_warc(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """Records of WARC files: (file, record_type, record_id, refers_to_id, uri, date, page_id, refers_to, payload_bytes, payload_digest, intact, head, payload).

    Bytes and digest are of the full payload: a revisit's are those that it declares. intact says whether the declared digests of block and
    payload are those of the bytes read. Without bodies head and payload are null.
    """

    def parse(name: str, stream: BinaryIO) -> Iterator[tuple[int, tuple]]:
        for own, block in warc_parts(stream):
            kind = field(own, b"WARC-Type")
            head, payload = http_parts(block)
            said = (field(own, b"WARC-Payload-Digest") or "").removeprefix("sha256:")
            size = field(head, b"Content-Length") if kind == "revisit" else str(len(payload))
            digest = said if kind == "revisit" else _sha(payload)
            intact = field(own, b"WARC-Block-Digest") == f"sha256:{_sha(block)}" and said in ("", digest)
            ids = (field(own, k) for k in (b"WARC-Record-ID", b"WARC-Refers-To", b"WARC-Target-URI", b"WARC-Date"))
            facts = (name, kind, *ids, field(head, b"X-Page-Id"), field(own, b"X-Refers-To-Page"), int(size) if size and size.isdigit() else None, digest, intact)
            yield (len(block) if bodies else 200), (*facts, *((head, payload) if bodies else (None, None)))

    schema = "file string, record_type string, record_id string, refers_to_id string, uri string, date string, page_id string, refers_to string, payload_bytes long, payload_digest string, intact boolean, head binary, payload binary"
    return _read(spark, path, parse, schema)


def converted_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for every row of pages(page_id, url, html).

    Pages are written as ARC files of both versions, converted to WARC files, and read back from those. Null html is empty. A page
    without an id is a response, and no page refers to it; of repeated rows of the smallest id each is a response. An empty table gives an
    empty result.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    convert_arc(spark, arc, warc, kind)
    for path in (arc, warc):
        removed_at_end(spark, path)
    rows = read_warc(spark, warc).where(F.col("record_type").isin("response", "revisit"))
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
