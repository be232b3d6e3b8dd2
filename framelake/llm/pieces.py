"""SentencePiece encoding by a batched numpy Viterbi search over a model's scored pieces, and decoding.

The model's normaliser must be the identity with a dummy prefix; its pieces may hold the space mark only
at their start or alone, so words (a run of space marks and what follows) can be encoded one by one.
A path's score is the sum of its pieces' scores; a sign without a piece costs the lowest score less 10
and is written as its UTF-8 bytes. Of equal paths the one with the shorter last piece wins.
A literal space mark (U+2581) in a text is written as bytes, so decoding gives back every text exactly.
Memory is bounded by a block of BLOCK_SIGNS, or by the longest word where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.textarrays import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_SIGNS = 600_000
_MARK, _LITERAL = 0x2581, 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FILTER = 22


def load_model(path: str = MODEL) -> dict[str, np.ndarray]:
    """Arrays of a model file: sorted piece hashes with ids and scores, byte ids, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    names = {i: model.id_to_piece(i) for i in plain}
    if any("▁" in p[1:] and p.strip("▁") for p in names.values()):
        raise ValueError("a piece holds a space mark inside")
    size = max(map(len, names.values()))
    keys = np.array([_hash(np.array([ord(c) for c in names[i]])) for i in plain], np.uint64)
    order = np.argsort(keys)
    ids, scores = np.array(plain)[order], np.array([model.get_score(i) for i in plain])[order]
    output = [b""] * n
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value], output[i] = i, bytes([value])
        elif i in names:
            output[i] = names[i].replace("▁", " ").encode()
    seen = np.zeros(1 << _FILTER, bool)
    seen[keys >> np.uint64(64 - _FILTER)] = True
    at = np.concatenate([[0], np.cumsum([len(o) for o in output])]).astype(np.int64)
    return {"keys": keys[order], "ids": ids.astype(np.int32), "scores": scores, "seen": seen, "width": np.array(size), "byte_ids": byte_ids, "out": np.frombuffer(b"".join(output), np.uint8), "out_at": at}


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(len(points) + 1, _BASE, np.uint64)
    inverse = np.full(len(points) + 1, _INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1], out=total[1:])
    return total, np.cumprod(inverse)


def _hash(points: np.ndarray) -> np.uint64:
    total, _ = _sums(points)
    return mix(total[-1:])[0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of many ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def parted(piece: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of words cut further at places that no piece spans: no path can, so the parts are searched apart and long words advance in many of them at once."""
    width, n = piece.shape
    spans = np.zeros(n + 1, np.int64)
    for w in range(2, width + 1):
        start = np.flatnonzero(piece[w - 1] >= 0)
        spans[start + 1] += 1  # starts are distinct
        spans[start + w] -= 1
    free = np.cumsum(spans)[:n] == 0
    return np.union1d(np.flatnonzero(free), at) if n else at


def best_paths(points: np.ndarray, at: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, start and piece id (-1: none) of the best path of each word; words are ranges of points given by offsets."""
    width, n = int(model["width"]), len(points)
    total, inverse = _sums(points)
    score = np.full((width, n), -np.inf)
    piece = np.full((width, n), -1, np.int32)
    end_of = np.repeat(at[1:], np.diff(at))
    for w in range(1, width + 1):
        start = np.flatnonzero(np.arange(n) + w <= end_of)
        key = mix((total[start + w] - total[start]) * inverse[start])
        some = model["seen"][key >> np.uint64(64 - _FILTER)]
        start, key = start[some], key[some]
        place = np.minimum(np.searchsorted(model["keys"], key), len(model["keys"]) - 1)
        hit = model["keys"][place] == key
        score[w - 1, start[hit]] = model["scores"][place[hit]]
        piece[w - 1, start[hit]] = model["ids"][place[hit]]
    score[0][piece[0] < 0] = model["scores"].min() - 10
    words, at = at, parted(piece, at)
    best = np.zeros(n + len(at) - 1)  # a part's points and one place more
    back = np.zeros(n + len(at) - 1, np.int32)
    size = np.diff(at)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts):  # words of equal length advance together
        base = at[group]
        room = base + group
        for e in range(1, int(size[group[0]]) + 1 if len(group) else 0):
            w = np.arange(1, min(width, e) + 1)[:, None]
            ways = best[room + e - w] + score[w - 1, base + e - w]
            pick = ways.argmax(0)
            best[room + e] = ways[pick, np.arange(len(group))]
            back[room + e] = pick + 1
    start, ids = [], []
    live, end = np.flatnonzero(size > 0), size[size > 0]
    while len(live):
        step = back[at[live] + live + end]
        end = end - step
        start.append(at[live] + end)
        ids.append(piece[step - 1, at[live] + end])
        live, end = live[end > 0], end[end > 0]
    if not start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    start, ids = np.concatenate(start), np.concatenate(ids)
    order = np.argsort(start)
    return np.searchsorted(words, start[order], "right") - 1, start[order], ids[order]


def _utf8_bytes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points (a literal space mark stands outside Unicode here), and how many each has."""
    raw = [chr(_MARK if p == _LITERAL else p).encode("utf-8", "surrogatepass") for p in points.tolist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def cut(text: str, size: int = BLOCK_SIGNS) -> list[str]:
    """A spaced text in parts of about `size` signs, each beginning with a word (a longer word is a part of its own)."""
    parts, first = [], 0
    while len(text) - first > size:
        at = text.find(" ", first + size)
        while at > 0 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[first:at])
        first = at
    return [*parts, text[first:]]


def encode(texts: list[str], model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and offsets; an empty text has none. A long text is encoded part by part."""
    parts = [cut(" " + t) if t else [""] for t in texts]
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held: list[str] = []
    signs = 0
    for part in (p for own in parts for p in own):
        held.append(part)
        signs += len(part)
        if signs >= BLOCK_SIGNS:
            found, at = _encode_parts(held, model)
            ids, sizes, held, signs = [*ids, found], [*sizes, np.diff(at)], [], 0
    found, at = _encode_parts(held, model)
    run = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.diff(at)]))])
    return np.concatenate([*ids, found]).astype(np.int32), run[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]


def _encode_parts(spaced: list[str], model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of parts of texts, each empty or beginning with a space."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points == _MARK, _LITERAL, np.where(points == 32, _MARK, points))
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(spaced) + 1, np.int64)
    mark = points == _MARK
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    first[at[:-1][at[:-1] < len(points)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(points))
    total, inverse = _sums(points)
    _, where, which = np.unique(mix((total[ends] - total[starts]) * inverse[starts]), return_index=True, return_inverse=True)
    sizes = (ends - starts)[where]
    flat = points[_spread(starts[where], sizes)]
    word, start, ids = best_paths(flat, np.concatenate([[0], np.cumsum(sizes)]), model)
    lost = np.flatnonzero(ids < 0)
    raw, n_raw = _utf8_bytes(flat[start[lost]])
    per = np.ones(len(ids), np.int64)
    per[lost] = n_raw
    wide = np.repeat(ids, per)
    wide[wide < 0] = model["byte_ids"][raw]
    per_word = np.bincount(word, per, len(where)).astype(np.int64)
    word_at = np.concatenate([[0], np.cumsum(per_word)])
    out = wide[_spread(word_at[which], per_word[which])]
    run = np.concatenate([[0], np.cumsum(per_word[which])])
    return out, run[np.searchsorted(starts, at)]


def decode(ids: np.ndarray, at: np.ndarray, model: dict[str, np.ndarray]) -> list[str]:
    """The texts that runs of ids stand for; control ids stand for nothing, broken bytes for U+FFFD."""
    sizes = np.diff(model["out_at"])[ids]
    data = model["out"][_spread(model["out_at"][ids], sizes)].tobytes()
    run = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
    return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(run[:-1], run[1:], strict=True)]


def encoded(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model_path: str = MODEL) -> DataFrame:
    """(row, token_ids, decoded) for every row of docs; row holds the kept columns. Null texts are empty.

    The model file is read once, by the driver; its arrays (a vocabulary's size) go to every task.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first = size = 0
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size >= BLOCK_SIGNS or i + 1 == len(texts):
                    ids, at = encode(texts[first : i + 1], model)
                    tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.record_batch([batch.column(0).slice(first, i + 1 - first), tokens, pa.array(decode(ids, at, model), pa.string())], ["row", "token_ids", "decoded"])
                    first, size = i + 1, 0

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, token_ids array<int>, decoded string")


def encoded_documents(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256) for every row of documents; null texts are empty.

    decoded_sha256 is of the text that the ids decode to, which is the text itself. Repeated rows stay;
    an empty table gives an empty result.
    """
    out = encoded(docs, model_path=model_path)
    return out.select("row.doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))
