"""Fill-in-middle rearrangement: texts are cut after whole lines that a compressed set of line ends gives by rank.

The set holds the byte position at which each line ends. Positions that share all but their last 16 bits form a container:
a sorted array, a bitmap or a list of runs, whichever is smallest. Cumulative cardinalities lead from a rank to
its container, a local select to the position inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.textarrays import blocks, counts_before

#: Marks before prefix, suffix and middle. A text that holds one stays plain, so each occurs once in an output.
MARKS = ("<P>", "<S>", "<M>")
SPAN = 1 << 16
_BITMAP_BYTES = SPAN // 8
_NEWLINE = 10


@dataclass(frozen=True)
class Positions:
    """A sorted set: high parts, members before each container (and in all), containers as (kind, values)."""

    high: np.ndarray
    before: np.ndarray
    containers: list[tuple[str, np.ndarray]]

    def __len__(self) -> int:
        return int(self.before[-1])


def container(low: np.ndarray) -> tuple[str, np.ndarray]:
    """Ascending low parts in the smallest form: "run" rows (first, length), "array" of values, or "bitmap" of 64-bit words."""
    first = np.flatnonzero(np.append(True, np.diff(low) != 1))
    if 4 * len(first) < min(2 * len(low), _BITMAP_BYTES):
        return "run", np.stack([low[first], np.diff(np.append(first, len(low)))], 1).astype(np.uint32)
    if 2 * len(low) <= _BITMAP_BYTES:
        return "array", low.astype(np.uint16)
    flags = np.zeros(SPAN, np.uint8)
    flags[low] = 1
    return "bitmap", np.packbits(flags, bitorder="little").view(np.uint64)


def local_select(kind: str, values: np.ndarray, rank: int) -> int:
    """The low part with `rank` smaller ones in its container."""
    if kind == "array":
        return int(values[rank])
    sizes = values[:, 1].astype(np.int64) if kind == "run" else np.bitwise_count(values).astype(np.int64)
    upto = np.cumsum(sizes)
    at = int(np.searchsorted(upto, rank, "right"))
    inside = rank - int(upto[at] - sizes[at])
    if kind == "run":
        return int(values[at, 0]) + inside
    return 64 * at + int(np.flatnonzero(np.unpackbits(values[at : at + 1].view(np.uint8), bitorder="little"))[inside])


def line_ends(data: np.ndarray) -> Positions:
    """Last byte of each line (`[^\\n]*\\n|[^\\n]+`) of UTF-8 bytes; only one container's bytes are looked at at a time."""
    high, sizes, containers = [], [], []
    for start in range(0, len(data), SPAN):
        part = data[start : start + SPAN]
        low = np.flatnonzero(part == _NEWLINE)
        if start + SPAN >= len(data) and part[-1] != _NEWLINE:
            low = np.append(low, len(part) - 1)
        if len(low):
            high.append(start // SPAN)
            sizes.append(len(low))
            containers.append(container(low))
    return Positions(np.array(high, np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), containers)


def select(ends: Positions, rank: int) -> int:
    """The member with `rank` smaller ones."""
    at = int(np.searchsorted(ends.before, rank, "right")) - 1
    return int(ends.high[at]) * SPAN + local_select(*ends.containers[at], rank - int(ends.before[at]))


def cut_after(ends: Positions, units: int) -> int:
    """Bytes in the first `units` lines."""
    return select(ends, units - 1) + 1 if units else 0


_KINDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def rearranged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", key_col: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for every row of docs; row holds the kept columns.

    n counts lines. With h1 to h4 the first groups of eight hex digits of the SHA-256 of "seed:key", the prefix ends after the smaller and the
    middle after the larger of h1 % (n + 1) and h2 % (n + 1) lines. Form is "plain" for empty texts, ones with a mark and
    where h3 % 100 >= rate; else "spm" where h4 % 100 < spm_rate, else "psm". Null texts are empty, a null key
    is the empty one. Equal cuts leave a part empty. Repeated rows stay, and an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), draws.alias("draws"))
    marks = [m.encode() for m in MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            for first, end, data, at in blocks(batch.column(1)):
                chars = counts_before((data & 0xC0) != 0x80)
                out: list[tuple] = []
                for (h1, h2, h3, h4), a, b in zip(drawn[first:end].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ends, raw = line_ends(data[a:b]), data[a:b].tobytes()
                    n = len(ends)
                    if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
                        out.append((n, "plain", None, None, raw))
                        continue
                    p, m = (cut_after(ends, units) for units in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = (mark + part for mark, part in zip((marks[0], marks[2], marks[1]), (raw[:p], raw[p:m], raw[m:]), strict=True))
                    spm = h4 % 100 < spm_rate
                    out.append((n, "spm" if spm else "psm", int(chars[a + p] - chars[a]), int(chars[a + m] - chars[a + p]), suffix + prefix + middle if spm else prefix + suffix + middle))
                n, form, before, between, texts = zip(*out, strict=True)
                columns = [batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(texts, pa.binary()).view(pa.string())]
                yield pa.record_batch(columns, ["row", *[k.split()[0] for k in _KINDS.split(", ")]])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {_KINDS}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Marks can't overlap parts, as no mark holds a "<" but its first sign."""
    part = F.split(output, "|".join(MARKS), -1)
    in_order = F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
    return in_order.when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(output)


def rearranged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for every row of documents; cases as in `rearranged`."""
    out = rearranged(docs)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
