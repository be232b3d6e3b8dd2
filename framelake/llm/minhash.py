"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.storage import written
from framelake.llm.textarrays import blocks, mix, shingle_hashes, span_hashes, words

BINS = 256
BITS = 4
SHINGLE = 5
_PROBES = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probes() -> np.ndarray:
    """For each bin the order in which it borrows from others: a hash of bin and attempt."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, _PROBES + 1, dtype=np.uint64), indexing="ij")
    return (mix(bins * np.uint64(_PROBES + 1) + tries) % np.uint64(BINS)).astype(np.int64)


PROBES = _probes()


def densified(minima: np.ndarray) -> np.ndarray:
    """Each row's empty bins filled from the first full bin on their probe sequence."""
    full = minima != _EMPTY
    out = minima.copy()
    row, col = np.nonzero(~full & full.any(1, keepdims=True))
    for t in range(_PROBES):
        take = PROBES[col, t]
        hit = full[row, take]
        out[row[hit], col[hit]] = minima[row[hit], take[hit]]
        row, col = row[~hit], col[~hit]
    for step in range(1, BINS):  # sparse rows: the next full bin to the right
        if not len(row):
            break
        take = (col + step) % BINS
        hit = full[row, take]
        out[row[hit], col[hit]] = minima[row[hit], take[hit]]
        row, col = row[~hit], col[~hit]
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> list[bytes]:
    """Packed fingerprint of each text: BINS values of BITS bits; a text without words has an empty one."""
    out: list[bytes] = []
    for first, end, data, at in blocks(texts):
        n = end - first
        starts, ends, doc = words(data, at)
        hashes, doc = shingle_hashes(span_hashes(data, starts, ends), doc, n, shingle)
        minima = np.full(n * BINS, _EMPTY, np.uint64)
        np.minimum.at(minima, doc * BINS + (hashes >> np.uint64(56)).astype(np.int64), mix(hashes) >> np.uint64(1))
        minima = densified(minima.reshape(n, BINS))
        # each bin draws its bits anew, so that a value borrowed by many bins doesn't collide in all of them
        low = (mix(minima + np.arange(BINS, dtype=np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        packed = low[:, 0::2] << BITS | low[:, 1::2]
        some = (minima[:, 0] != _EMPTY).tolist()
        out += [row.tobytes() if ok else b"" for row, ok in zip(packed, some, strict=True)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: the share of equal values less what chance makes equal, in 0 to 1.

    Two empty fingerprints are alike (1), an empty and another one are not (0).
    """
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8), 1 / (1 << BITS)
    equal = ((x >> BITS == 0).sum() + (x & ((1 << BITS) - 1) == 0).sum()) / BINS
    return float(min(1.0, max(0.0, (equal - y) / (1 - y))))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str], own: list[bytes], after: list[bytes]) -> dict[str, list]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    edit = fingerprints(pa.array(changed, pa.string()))
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [x.hex() for x in own],
        "edited_fingerprint": [x.hex() for x in edit],
        "near_edited": [likeness(a, b) for a, b in zip(own, edit, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(own, after, strict=True)],
    }


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition: each but the last is done with the row after it; ends keep their text."""
    part = TaskContext.get().partitionId()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "head", "tail", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]

    def batch(columns: dict[str, list], head: bool, tail: bool, text: str | None = None) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        more = {"part": [part] * n, "head": [head] + [False] * (n - 1), "tail": [tail] * n, "text": [text] + [None] * (n - 1)}
        return pa.record_batch([pa.array((columns | more)[k], t) for k, t in zip(names, kinds, strict=True)], names)

    first, held = True, None
    for rows in batches:
        step = 2048
        for i in range(0, len(rows), step):
            piece = rows.slice(i, step)
            ids, texts = piece.column(0).to_pylist(), [t or "" for t in piece.column(1).to_pylist()]
            own = fingerprints(piece.column(1))
            if held:
                ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
            if len(ids) > 1:
                yield batch(_rows(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), first, False, texts[0] if first else None)
                first = False
            held = ids[-1], texts[-1], own[-1]
    if held:
        blank = {"doc_id": [held[0]], "n_chars": [len(held[1])], "fingerprint": [held[2].hex()]}
        yield batch(blank | {k: [None] for k in ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")}, first, True, held[1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if len(rows):
            ids, texts, own, following, after = (c.to_pylist() for c in rows.columns)
            columns = _rows(ids, texts, following, [bytes.fromhex(x) for x in own], [bytes.fromhex(x) for x in after])
            yield pa.record_batch([pa.array(columns[f.split()[0]]) for f in _FIELDS.split(", ")], [f.split()[0] for f in _FIELDS.split(", ")])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row, of its edited text, and their likeness; likeness to the next row's.

    The edited text has its last quarter replaced by as many code points (or all) of the next document in
    doc_id order; the last document is followed by the first. Null texts count as empty: fingerprint "",
    like only to another empty one. Rows that share a doc_id follow each other in the order of a
    hash of their texts; a single row follows itself; an empty table gives an empty result. Columns beside doc_id and
    text are ignored.

    One range shuffle brings rows into doc_id order. Inside a partition the next row is at hand; the last
    row of each partition is joined with the first one of the next, a row for each partition.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # repeated ids go by a hash of their text, and equal rows, which are alike, by a seeded draw: no id is one task's
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("by"), F.rand(7).alias("draw"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "by", "draw").sortWithinPartitions("doc_id", "by", "text", "draw").select("doc_id", "text")
    done = written(ordered.mapInArrow(_in_order, f"{_FIELDS}, part int, head boolean, tail boolean, text string"), "fingerprints")
    order = sorted(r["part"] for r in done.where("tail").select("part").collect())  # one number a partition
    follows = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, after int")
    heads = done.where("head").select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("next"))
    tails = done.where("tail").join(F.broadcast(follows), "part").join(heads, "after").select("doc_id", "text", "fingerprint", "following", "next")
    return done.where("not tail").selectExpr(*[f.split()[0] for f in _FIELDS.split(", ")]).unionByName(tails.mapInArrow(_ends, _FIELDS))
