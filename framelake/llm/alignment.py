"""Alignment of two tokenizers over the bytes of texts: groups between shared token ends, links between overlapping tokens.

A text is encoded in units, each from a space that follows no space and precedes a sign: neither tokenizer joins
signs across such a place (A's pattern takes a space only before what follows it, none of B's pieces holds a space after another sign), so units
are encoded apart, each distinct one of a block once. A run without such a place is one unit.

A text of over CHUNK_BYTES is cut into byte ranges, wherever their edges fall; these are dealt to all tasks, each with the units
that it touches. A range owns the tokens that end in it and yields a Fragment: the tokens up to its first shared end
(open prefix), the groups between (closed), the tokens after its last shared end (open suffix). `combined` joins
neighbours and is associative, so fragments are combined in a tree of Spark groups.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.pieces import _spread
from framelake.llm.storage import written
from framelake.llm.textarrays import blocks, counts_before

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of texts whose units are told apart together, and of a range of a long text; units that are encoded in one call.
BLOCK_BYTES, CHUNK_BYTES, STEP = 2_000_000, 32_768, 8_192
#: Units that a worker process remembers (some 100 bytes each); then it starts anew.
REMEMBERED = 400_000
#: Neighbours that one step of the tree combines.
FAN = 8
#: Pairs of ids that a task looks up at once (17 bytes each), and that it counts before it sends them on.
PIECE, HELD_PAIRS = 4_000_000, 2_000_000
#: Bits of a pair's code that hold B's id.
B_BITS = 24
_SPACE = 32
_CLOSES = np.zeros(256, bool)  # first bytes after a space that can't begin white space or stand for nothing
_CLOSES[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


class Fragment(NamedTuple):
    """Tokens of a byte range; closed is None where no end in it is shared, and then all tokens are in first_a and first_b."""

    first_a: list[int]
    first_b: list[int]
    closed: str | None
    n_closed: int
    last_a: list[int]
    last_b: list[int]


NOTHING = Fragment([], [], None, 0, [], [])


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def combined(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if x.closed is None:
        return Fragment(x.first_a + y.first_a, x.first_b + y.first_b, *y[2:])
    if y.closed is None:
        return Fragment(*x[:4], x.last_a + y.first_a, x.last_b + y.first_b)
    parts = [x.closed, group_text(x.last_a + y.first_a, x.last_b + y.first_b), y.closed]
    return Fragment(x.first_a, x.first_b, ";".join(p for p in parts if p), x.n_closed + 1 + y.n_closed, y.last_a, y.last_b)


def spelled(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """Tokens of A and B, given as (ids, groups, texts), in the order in which a text spells them, each after the sign that parts it from the one before; and whose they are."""
    part = np.concatenate([a[1] * 2, b[1] * 2 + 1])
    order = np.argsort(part, kind="stable")
    part, text = part[order], np.concatenate([a[2], b[2]])[order]
    new = lambda x: np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    sign = np.where(new(text), 0, np.where(~new(part), 3, np.where(part % 2 == 1, 2, 1)))
    signs = pa.array(["", ";", "|", ","], pa.large_string()).take(pa.array(sign))
    ids = pa.array(np.concatenate([a[0], b[0]])[order]).cast(pa.large_string())
    return text, pc.binary_join_element_wise(signs, ids, pa.scalar("", pa.large_string()))


def fragment(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a byte range, from their ids and ends."""
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(shared):
        return Fragment(a_ids.tolist(), b_ids.tolist(), None, 0, [], [])
    (a0, a1), (b0, b1) = (np.searchsorted(ends, shared[[0, -1]], "right") for ends in (a_ends, b_ends))
    inner = [(ids[i:j], np.searchsorted(shared, ends[i:j]), np.zeros(j - i, np.int64)) for ids, ends, i, j in ((a_ids, a_ends, a0, a1), (b_ids, b_ends, b0, b1))]
    closed = "".join(spelled(*inner)[1].to_pylist())
    return Fragment(a_ids[:a0].tolist(), b_ids[:b0].tolist(), closed, len(shared) - 1, a_ids[a1:].tolist(), b_ids[b1:].tolist())


class Tokenizers:
    """Both tokenizers of a task, and the bytes of each of their ids."""

    def __init__(self, a_model: bytes, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # fixed values: the signs that byte-level vocabularies write for bytes that aren't printable
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(names.values(), default=0) + 1)
        for name, i in names.items():
            a_bytes[i] = bytes(sign[c] for c in name if c in sign)
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            if "▁" in name.lstrip("▁"):
                raise ValueError("a piece holds a space mark inside")
            b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else name.replace("▁", " ").encode())
        self.a_out, self.b_out = _table(a_bytes), _table(b_bytes)
        self.forget()

    def forget(self) -> None:
        self.known, self.good = pa.array([], pa.large_binary()), np.zeros(0, bool)
        self.a_ids, self.b_ids = ((np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in range(2))

    def encoded(self, units: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Whether each of some distinct units is given back by both encodings, and then both tokenizers' ids, with offsets; only units that aren't remembered are encoded."""
        place = pc.index_in(units, value_set=self.known)
        fresh = units.filter(pc.is_null(place))
        if len(self.known) and len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            return self.encoded(units)
        if len(fresh):
            raw = fresh.to_pylist()
            own, own_at = _table(raw)
            a, b = self.ids([u.decode("utf-8", "replace") for u in raw])
            good = _right(own, own_at, *a, self.a_out) & _right(own, own_at, *b, self.b_out)
            kept = [(ids[_spread(at[:-1], n)].astype(np.int32), np.cumsum(n)) for ids, at in (a, b) for n in [np.where(good, np.diff(at), 0)]]
            self.a_ids, self.b_ids = ((np.concatenate([old[0], ids]), np.concatenate([old[1], old[1][-1] + ends])) for old, (ids, ends) in zip((self.a_ids, self.b_ids), kept, strict=True))
            self.known, self.good = pa.concat_arrays([self.known, fresh]), np.concatenate([self.good, good])
            place = pc.index_in(units, value_set=self.known)
        at = place.to_numpy().astype(np.int64)
        sides = [(ids[_spread(ids_at[:-1][at], n)].astype(np.int64), np.concatenate([[0], np.cumsum(n)])) for ids, ids_at in (self.a_ids, self.b_ids) for n in [np.diff(ids_at)[at]]]
        return self.good[at], *sides

    def ids(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids and offsets by unit, of A and of B; B adds the space that a unit begins with itself."""
        steps = [units[i : i + STEP] for i in range(0, len(units), STEP)]
        a = [_flat([e.ids for e in self.a.encode_batch_fast(u, add_special_tokens=False)]) for u in steps]
        return _joined(a), _joined([_flat(self.b.encode([x[1:] for x in u], num_threads=1)) for u in steps])


@lru_cache(maxsize=1)
def tokenizers_of(a_model: bytes, b_model: bytes) -> Tokenizers:
    """Loaded once a worker process, whatever the number of its tasks."""
    return Tokenizers(a_model, b_model)


def _sent(session: SparkSession, a_file: str, b_file: str) -> Broadcast:
    """Both model files (a few MB), read by the driver."""
    return session.sparkContext.broadcast((Path(a_file).read_bytes(), Path(b_file).read_bytes()))


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many each list has."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [])))
    return ids, np.concatenate([[0], np.cumsum(sizes)])


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units of spaced texts begin: at each text, and at a space after no space and before a sign."""
    first = np.zeros(len(data), bool)
    if len(data) > 2:
        space = data == _SPACE
        first[1:-1] = space[1:-1] & ~space[:-2] & _CLOSES[data[2:]]
    begins, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
    first[ends - 1] = False  # a space that ends a text precedes nothing
    first[begins] = True
    return np.flatnonzero(first)


def _right(data: np.ndarray, at: np.ndarray, ids: np.ndarray, ids_at: np.ndarray, out: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the bytes of each unit's ids are the unit's own."""
    sizes = np.diff(out[1])[ids]
    upto = np.concatenate([[0], np.cumsum(sizes)])[ids_at]
    good = np.diff(upto) == np.diff(at)
    flat = out[0][_spread(out[1][ids], sizes)]
    some = np.flatnonzero(good)
    own = np.diff(at)[some]
    same = counts_before(flat[_spread(upto[some], own)] != data[_spread(at[some], own)])
    edge = np.concatenate([[0], np.cumsum(own)])
    good[some] = same[edge[1:]] == same[edge[:-1]]
    return good


class Units(NamedTuple):
    """The units of a block: where each text's begin, which distinct one each is, and what the distinct ones hold."""

    at: np.ndarray
    which: np.ndarray
    good: np.ndarray
    a: tuple[np.ndarray, np.ndarray]
    b: tuple[np.ndarray, np.ndarray]


def encoded_units(data: np.ndarray, at: np.ndarray, tokenizers: Tokenizers) -> Units:
    """Both tokenizers' ids of the units of spaced texts; an encoding that doesn't give back the unit's bytes is no good and left empty."""
    starts = unit_starts(data, at)
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()
    return Units(np.searchsorted(starts, at), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), *tokenizers.encoded(coded.dictionary))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[at[1:]] - run[at[:-1]]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def _distinct(text: np.ndarray, kind: np.ndarray, n: int, n_kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct kinds of each text, how often each occurs, and offsets by text."""
    keys, times = _counted(text * n_kinds + kind)
    return keys % n_kinds, times, np.searchsorted(keys, np.arange(n + 1) * n_kinds)


_FOUND = "n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"


def aligned_block(units: Units, tokenizers: Tokenizers) -> list[pa.Array]:
    """The columns of _FOUND for the texts of a block; an empty text, or one with an encoding that is no good, has no tokens."""
    n = len(units.at) - 1
    (a_ids, a_at), (b_ids, b_at) = units.a, units.b
    a_ends, b_ends = (np.cumsum(np.diff(out[1])[ids]) for ids, out in ((a_ids, tokenizers.a_out), (b_ids, tokenizers.b_out)))
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    unit_of = lambda ids_at: np.repeat(np.arange(len(units.good)), np.diff(ids_at))
    unit, tokens = spelled((a_ids, np.searchsorted(shared, a_ends), unit_of(a_at)), (b_ids, np.searchsorted(shared, b_ends), unit_of(b_at)))
    texts = pc.binary_join(pa.LargeListArray.from_arrays(np.searchsorted(unit, np.arange(len(units.good) + 1)), tokens), pa.scalar("", pa.large_string()))
    # links: a token of A and one of B over each stretch between ends
    every = np.union1d(a_ends, b_ends)
    own_a, own_b = np.searchsorted(a_ends, every), np.searchsorted(b_ends, every)
    codes, kind = np.unique(a_ids[own_a] << B_BITS | b_ids[own_b], return_inverse=True)
    link_at = np.searchsorted(own_a, a_at)
    n_shared = np.diff(np.searchsorted(shared, np.concatenate([[0], a_ends])[a_at], "right"))
    # texts as sequences of units
    text = np.repeat(np.arange(n), np.diff(units.at))
    bad = np.zeros(n, bool)
    bad[text[~units.good[units.which]]] = True
    which, text = units.which[~bad[text]], text[~bad[text]]
    unit_at = np.searchsorted(text, np.arange(n + 1))
    n_links = np.diff(link_at)[which]
    kinds, times, pair_at = _distinct(np.repeat(text, n_links), kind[_spread(link_at[:-1][which], n_links)], n, max(1, len(codes)))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(unit_at, texts.take(pa.array(which))), pa.scalar(";", pa.large_string()))
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(pair_at, pa.int32()), pa.array(values, kind))
    sums = [pa.array(_sums(values[which], unit_at)) for values in (np.diff(a_at), np.diff(b_at), n_shared)]
    return [*sums, joined.cast(pa.string()), lists(codes[kinds], pa.int64()), lists(times, pa.int32())]


def spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that isn't empty."""
    full = np.diff(at) > 0
    return np.insert(data, at[:-1][full], _SPACE), at + np.concatenate([[0], np.cumsum(full)])


def ranges(data: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges (low, high) of a spaced text, and where the units that they touch begin and end.

    A range has `size` bytes; an edge inside a unit of over `size` bytes moves to the unit's end, so that few ranges share it.
    """
    starts = np.append(unit_starts(data, np.array([0, len(data)])), len(data))
    low = 0
    while low < len(data):
        high = min(low + size, len(data))
        own = int(np.searchsorted(starts, high)) - 1  # the unit that holds the byte before the edge
        if starts[own + 1] - starts[own] > size:
            high = int(starts[own + 1])
        yield low, high, int(starts[np.searchsorted(starts, low, "right") - 1]), int(starts[own + 1])
        low = high


_CHUNK = "text_id long, no long, low long, high long, chunk binary"
_PART = "text_id long, no long, bad boolean, n_a long, n_b long, first_a array<int>, first_b array<int>, closed string, n_closed long, last_a array<int>, last_b array<int>"


def chunked(texts: DataFrame, size: int) -> DataFrame:
    """texts(text_id, text) as ranges (text_id, no, low, high, chunk): the bytes of the touched units, and where in them the range lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, at in blocks(batch.column(1), 1):
                data = spaced(data, at)[0]
                for no, (low, high, begin, end) in enumerate(ranges(data, size)):
                    columns = [batch.column(0).slice(first, 1), *(pa.array([v], pa.int64()) for v in (no, low - begin, high - begin)), pa.array([data[begin:end].tobytes()], pa.binary())]
                    yield pa.record_batch(columns, _names(_CHUNK))

    return texts.select("text_id", "text").mapInArrow(run, _CHUNK)


def range_part(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], low: int, high: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(n_a, n_b, fragment), distinct links and their numbers of the tokens (ids, ends) that end after `low`, not after `high`; a link ends where the earlier of its tokens does."""
    own = [(ids[slice(*at)], ends[slice(*at)]) for ids, ends in (a, b) for at in [np.searchsorted(ends, [low, high], "right")]]
    every = np.union1d(own[0][1], own[1][1])
    codes = a[0][np.searchsorted(a[1], every)] << B_BITS | b[0][np.searchsorted(b[1], every)]
    pairs, times = _counted(codes)
    return (len(own[0][0]), len(own[1][0]), *fragment(*own[0], *own[1])), pairs, times


def chunk_fragments(chunks: DataFrame, files: Broadcast) -> DataFrame:
    """The fragment of each range, and its distinct links: _PART and pairs, times. A range with an encoding that is no good is bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tokenizers_of(*files.value)
        ids, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = [pa.bool_(), pa.int64(), pa.int64(), ids, ids, pa.string(), pa.int64(), ids, ids, longs, ids]
        for batch in batches:
            low, high = (batch.column(k).to_numpy() for k in (2, 3))
            for first, end, data, at in blocks(batch.column(4).view(pa.string()), BLOCK_BYTES):
                units, rows = encoded_units(data, at, tokenizers), []
                for i in range(end - first):
                    which = units.which[units.at[i] : units.at[i + 1]]
                    if not units.good[which].all():
                        rows.append((True, 0, 0, *NOTHING, [], []))
                        continue
                    own = []
                    for (values, values_at), out in ((units.a, tokenizers.a_out), (units.b, tokenizers.b_out)):
                        values = values[_spread(values_at[:-1][which], np.diff(values_at)[which])]
                        own.append((values, np.cumsum(np.diff(out[1])[values])))
                    part, pairs, times = range_part(*own, low[first + i], high[first + i])
                    rows.append((False, *part, pairs, times))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([*(batch.column(k).slice(first, end - first) for k in (0, 1)), *columns], [*_names(_PART), "pairs", "times"])

    return chunks.mapInArrow(run, f"{_PART}, pairs array<long>, times array<int>")


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def folded(parts: DataFrame, most: int) -> DataFrame:
    """One row of _PART a text, from parts numbered under `most`: FAN neighbours are combined at each level of a tree."""

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        whole = reduce(combined, (Fragment(*[r[k] for k in Fragment._fields]) for r in rows), NOTHING)
        sums = [any(r["bad"] for r in rows), *(sum(r[k] for r in rows) for k in ("n_a", "n_b"))]
        values = [rows[0]["text_id"], rows[0]["no"] // FAN, *sums, *whole]
        ids = pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), ids, ids, pa.string(), pa.int64(), ids, ids]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_names(_PART))

    while most > 1:
        parts = parts.withColumn("_up", F.floor(F.col("no") / FAN)).groupBy("text_id", "_up").applyInArrow(lambda t: fold(t.drop_columns(["_up"])), _PART)
        most = -(-most // FAN)
    return parts


def _group(a: str, b: str) -> Column:
    return F.concat_ws("|", *[F.array_join(F.col(c).cast("array<string>"), ",") for c in (a, b)])


def aligned_long(texts: DataFrame, files: Broadcast, chunk_bytes: int) -> DataFrame:
    """(text_id, columns of _FOUND) for texts(text_id, text), range by range over all tasks."""
    session = texts.sparkSession
    chunks = chunked(texts, chunk_bytes).repartition(int(session.conf.get("spark.sql.shuffle.partitions")), "text_id", "no")
    parts = written(chunk_fragments(chunks, files), "fragments")
    most = (parts.agg(F.max("no")).first()[0] or 0) + 1
    whole = folded(parts.select(*_names(_PART)), most)
    links = parts.select("text_id", F.explode(F.arrays_zip("pairs", "times")).alias("l")).groupBy("text_id", F.col("l.pairs").alias("pair")).agg(F.sum("l.times").cast("int").alias("times"))
    links = links.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("pair", "times"))).alias("links"))  # as many as a text has
    text = F.concat_ws(";", _group("first_a", "first_b"), F.nullif("closed", F.lit("")))
    out = whole.join(links, "text_id", "left")
    fine = lambda value, empty: F.when(F.col("bad"), empty).otherwise(value)
    none = F.array().cast("array<struct<pair:bigint,times:int>>")
    out = out.withColumn("links", fine(F.coalesce("links", none), none))
    return out.select(
        "text_id", fine(F.col("n_a"), F.lit(0)).cast("long").alias("n_a"), fine(F.col("n_b"), F.lit(0)).cast("long").alias("n_b"), fine(F.col("n_closed") + 1, F.lit(0)).cast("long").alias("n_groups"),
        fine(text, F.lit("")).alias("groups"), F.col("links.pair").alias("pairs"), F.col("links.times").alias("times"),
    )


def aligned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, n_a, n_b, n_groups, groups, pairs, times) for every row of docs; row holds the kept columns.

    A encodes a space and the text, B the text, to which it adds the space; strings of special tokens are plain text. groups is
    `a1,a2|b1;a3|b2,b3`, ids between byte offsets at which tokens of both end. pairs are the distinct pairs of overlapping tokens (see `pair_code`),
    times how often each occurs; a text has n_a + n_b - n_groups such occurrences. Texts that are null or empty, or that either
    tokenizer's bytes don't give back, have none of it. Repeated rows stay; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    files = _sent(docs.sparkSession, a_file, b_file)
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tokenizers_of(*files.value)
        for batch in batches:
            for first, end, data, at in blocks(batch.column(1), BLOCK_BYTES):
                yield pa.record_batch([batch.column(0).slice(first, end - first), *aligned_block(encoded_units(*spaced(data, at), tokenizers), tokenizers)], ["row", *_names(_FOUND)])

    short = rows.where(~is_long).mapInArrow(run, f"row {kind}, {_FOUND}")
    long_texts = written(rows.where(is_long).withColumn("text_id", F.monotonically_increasing_id()), "long-texts")
    whole = aligned_long(long_texts, files, chunk_bytes)
    return short.unionByName(long_texts.select("text_id", "row").join(whole, "text_id").drop("text_id"))


def pair_code(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), B_BITS) + b


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of links(pairs) each pair stands, and whether no pair of the same id of A stands in more.

    Pairs are counted in the task before they are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair = np.concatenate([p for p, _ in held])
            kinds, at = np.unique(pair, return_inverse=True)
            return kinds, np.bincount(at, np.concatenate([n for _, n in held]), len(kinds)).astype(np.int64)

        for batch in batches:
            held.append(_counted(batch.column(0).flatten().to_numpy()))
            if sum(len(p) for p, _ in held) > HELD_PAIRS:
                held = [merged()]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield pa.record_batch([pa.array(x) for x in held[0]], ["pair", "n"])
                    held = []
        if held:
            yield pa.record_batch([pa.array(x) for x in merged()], ["pair", "n"])

    counts = written(links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    own = F.shiftright("pair", B_BITS)
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))  # at most A's vocabulary
    return counts.withColumn("a", own).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def looked_up(table: DataFrame, pairs: np.ndarray, n: np.ndarray, best: np.ndarray, carry: Column) -> DataFrame:
    """(text_id, carry, n_best, count_sum) of each row of table(text_id, pairs, times), over the given sorted pairs."""
    held = table.sparkSession.sparkContext.broadcast((pairs, n, best))
    rows = table.select("text_id", carry.alias("carry"), "pairs", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, first = held.value
        for batch in batches:
            code, times = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            size = pc.list_value_length(batch.column(2)).to_numpy()
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            place = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            times = np.where(known[place] == code, times, 0) if len(known) else np.zeros(0, np.int64)
            sums = [_sums(times * x[place], at) for x in (first, count)] if len(known) else [np.zeros(len(size), np.int64)] * 2
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, sums)], ["text_id", "carry", "n_best", "count_sum"])

    return rows.mapInArrow(run, f"text_id long, carry {rows.schema['carry'].dataType.simpleString()}, n_best long, count_sum long")


def scored_links(found: DataFrame, carried: list[str], piece: int = PIECE) -> DataFrame:
    """carried columns, n_best and count_sum of every row of found(pairs, times, ...).

    Of a row's links, n_best is how many have a pair that stands in the most rows of all pairs of its id of A (ties included), count_sum the
    sum over links of the rows that their pair stands in. Counts go to tasks in pieces of at most `piece` pairs; more pieces are as
    many passes over the pairs, whose sums are added.
    """
    table = written(found.withColumn("text_id", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(table), "pair-ranks")
    n = max(1, -(-counts.count() // piece))
    carry = F.struct(*carried)
    out: DataFrame | None = None
    for i in range(n):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(n)) == i).toArrow().sort_by("pair")
        part = looked_up(table, own["pair"].to_numpy(), own["n"].to_numpy(), own["best"].to_numpy().astype(np.int64), carry if i == 0 else F.lit(None).cast(table.select(carry.alias("c")).schema["c"].dataType))
        out = part if out is None else out.unionByName(part)
    if n > 1:
        out = out.groupBy("text_id").agg(F.first("carry", ignorenulls=True).alias("carry"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("carry.*", "n_best", "count_sum")


def aligned_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of documents.

    Each row counts as a document. Cases as in `aligned`; without tokens all numbers are 0 and the digest is empty.
    """
    found = aligned(docs, a_file=a_file, b_file=b_file)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    found = found.select("row.doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), digest.alias("groups_sha256"), "pairs", "times")
    out = scored_links(found, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
