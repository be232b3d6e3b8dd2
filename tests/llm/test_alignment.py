"""Alignment of tokenizers: the monoid's laws, and the query against a text-by-text version."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import alignment as A
from framelake.llm.textarrays import blocks


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.B_FILE), A.Tokenizers(open(A.A_FILE, "rb").read(), open(A.B_FILE, "rb").read())


def plain(text, both):
    """Tokens of the whole text by both libraries, groups and links by walking over bytes."""
    a, b, own = both
    if not text:
        return [], [], [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_of = [[out[0][out[1][i] : out[1][i + 1]].tobytes() for i in x] for x, out in zip(ids, (own.a_out, own.b_out), strict=True)]
    if any(b"".join(x) != (" " + text).encode() for x in bytes_of):
        return [], [], [], []
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in bytes_of]
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for high in shared:
        groups.append("|".join(",".join(str(i) for i, e in zip(x, y, strict=True) if low < e <= high) for x, y in zip(ids, ends, strict=True)))
        low = high
    links, j = [], 0
    for i, e in enumerate(ends[0]):
        start = e - len(bytes_of[0][i])
        while j and ends[1][j - 1] > start:
            j -= 1
        while j < len(ids[1]) and ends[1][j] - len(bytes_of[1][j]) < e:
            if ends[1][j] > start:
                links.append((ids[0][i], ids[1][j]))
            j += 1
    return ids[0], ids[1], groups, links


def expected(rows, both):
    found = [(key, plain(t, both)) for key, t in rows]
    docs = Counter(p for _, f in found for p in set(f[3]))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for key, (a, b, groups, links) in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((key, len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), sha))
    return sorted(out, key=str)


ends = st.lists(st.integers(1, 30), max_size=14, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.lists(st.integers(0, 31), max_size=5))
def test_fragments_of_any_ranges_combine_to_the_whole(a, b, cuts):
    a, b = np.array([*a, 31]), np.array([*b, 31])
    whole = A.fragment(a * 7, a, b * 3, b)
    edges = sorted({0, 31, *cuts})
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own_a, own_b = (x[(x > low) & (x <= high)] for x in (a, b))
        parts.append(A.fragment(own_a * 7, own_a, own_b * 3, own_b))
    assert reduce(A.combined, parts, A.NOTHING) == whole
    right = A.NOTHING
    for p in reversed(parts):
        right = A.combined(p, right)
    assert right == whole and whole.last_a == [] and whole.last_b == []


PIECES = ["the ", "Haus", "été", "  ", "\n", "\n\n ", " \n", "日本語", "。", " ", "　", " 12", "345", "'s", "…", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "😀", "\t", "\r\n", "é", " - ", "ab" * 30, "₂", " x"]


def test_units_are_encoded_as_in_the_whole_text(both):
    rng = random.Random(2)
    texts = ["".join(rng.choices([*PIECES, " wort", " and", " X"], k=rng.randint(1, 25))) for _ in range(1500)]
    for first, end, data, at in blocks(pa.array(texts), 10_000):
        units = A.encoded_units(*A.spaced(data, at), both[2])
        got = A.aligned_block(units, both[2])
        for i, t in enumerate(texts[first:end]):
            a, b, groups, links = plain(t, both)
            assert (got[0][i].as_py(), got[1][i].as_py(), got[2][i].as_py(), got[3][i].as_py()) == (len(a), len(b), len(groups), ";".join(groups)), repr(t)
            assert dict(zip(got[4][i].as_py(), got[5][i].as_py(), strict=True)) == Counter((x << A.B_BITS) + y for x, y in links)


def rows_of(rng):
    text = lambda n: "".join(rng.choices([*PIECES, " wort", " and", " lang"], k=n))
    rows = [(i, text(rng.randint(0, 40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "a▁b"), (105, rows[3][1]), (3, rows[3][1]), (None, "ohne id"), (106, "x" * 3000), (107, text(900)), (108, text(700) + "▁" + text(700)), (109, " ".join(["immer gleich"] * 700))]
    return rows


@pytest.mark.parametrize("chunk", [200, A.CHUNK_BYTES])
def test_query_is_text_by_text(spark, both, chunk, monkeypatch):
    rows = rows_of(random.Random(chunk))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(A.aligned, "__defaults__", (("doc_id",), "text", A.A_FILE, A.B_FILE, chunk))
    got = sorted((tuple(r) for r in A.aligned_documents(docs).collect()), key=str)
    assert got == expected(rows, both)


def test_pieces_of_the_counts_and_tree(spark, both):
    rows = rows_of(random.Random(9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "pairs", "n", "text_id", "carry", "no", "a")})
    found = A.aligned(docs, keep=("doc_id", "pairs"), chunk_bytes=100).select("row.doc_id", "n_a", "pairs", "times")
    got = sorted((tuple(r) for r in A.scored_links(found, ["doc_id", "n_a"], piece=50).collect()), key=str)
    assert got == sorted(((r[0], r[1], r[5], r[6]) for r in expected(rows, both)), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.aligned_documents(docs).count() == 0
    assert [tuple(r) for r in A.aligned_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ranges_cover_a_text_once():
    data = np.frombuffer(b" " + b"wort und  zwei " * 400 + b"x" * 900 + b" ende ", np.uint8)
    starts = [*A.unit_starts(data, np.array([0, len(data)])).tolist(), len(data)]
    found = list(A.ranges(data, 100))
    assert [f[0] for f in found] == [0, *[f[1] for f in found[:-1]]] and found[-1][1] == len(data) == found[-1][3]
    assert all(begin in starts and end in starts and begin <= low < high <= end and end - begin < 140 for low, high, begin, end in found if high - low == 100)
    assert sum(begin < low for low, _, begin, _ in found) > 10  # edges fall into a unit
    assert sum(end - begin > 900 for *_, begin, end in found) == 1  # the long unit is encoded once
