"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). A line's score comes from its own features and those of the lines
before and after it; neighbouring labels are tied by a 2 x 2 transition table. Forward and backward
messages give each line's marginal; the marginals, weighted by line length, give the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.samples import labelled_sample
from framelake.llm.textarrays import blocks, counts_before, owner, span_hashes, words

#: Labelled documents that the model is fitted on, and bytes of the longest of them.
MAX_TRAINING_DOCS = 4000
MAX_TRAINING_BYTES = 50_000
#: Lines of the longest of them: features of at most MAX_TRAINING_DOCS x MAX_TRAINING_LINES lines reach the driver.
MAX_TRAINING_LINES = 500
_FEATURES = 16


def _class(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


_UPPER, _LOWER, _DIGIT = (_class(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOL, _MARK, _STOP = _class(b"#*$%&|<>@^~=_+\\{}[]/"), _class(b"!?"), _class(b".,;:")


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, text and byte length of every \\n-split line of a block; an empty text has one empty line.

    Own features (shares of the line): upper case, digits, symbols, exclamation, stops, other bytes,
    words equal to the word before, words seen before in the line, words with a symbol in them, line equal
    to an earlier line, two-word runs seen before in the text; further its log length, words, and mean word length.
    """
    n = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    kind = np.concatenate([np.arange(n), owner(at, breaks)])
    order = np.argsort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    doc = kind[order]
    resort = np.lexsort((first, doc))
    first, doc = first[resort], doc[resort]
    last = np.append(doc[1:] != doc[:-1], True)
    stop = np.where(last, at[doc + 1], np.append(first[1:], 0) - 1)
    size = np.maximum(stop - first, 0)
    per = np.maximum(size, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        total = counts_before(flags)
        return (total[stop] - total[first]) / per

    starts, ends, _ = words(data, at)
    line = np.searchsorted(first, starts, "right") - 1
    # empty lines share their start with the next line: words belong to the last line that starts at or before them
    n_words = np.bincount(line, minlength=len(first)).astype(float)
    w = np.maximum(n_words, 1)
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    marks = counts_before(_SYMBOL[data] | _MARK[data])
    odd = marks[ends] > marks[starts]
    same = np.zeros(len(line), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])

    def seen(group: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, group))
        out = np.zeros(len(group), bool)
        out[order[1:]] = (value[order][1:] == value[order][:-1]) & (group[order][1:] == group[order][:-1])
        return out

    pairs = hashes[:-1] * np.uint64(31) ^ hashes[1:] if len(hashes) else hashes
    again = np.zeros(len(line), bool)
    if len(pairs):
        again[1:] = seen(doc[line[1:]], pairs) & (line[1:] == line[:-1])
    whole = span_hashes(data, first, np.maximum(stop, first)) if len(data) else np.zeros(len(first), np.uint64)
    total = lambda flags: np.bincount(line, flags, len(first)) / w
    high = (data & 0x80) > 0
    own = np.stack(
        [
            share(_UPPER[data]), share(_DIGIT[data]), share(_SYMBOL[data]), share(_MARK[data]), share(_STOP[data]), share(high),
            total(same), total(seen(line, hashes)), total(odd), (seen(doc, whole) & (size > 0)).astype(float), total(again),
            np.log1p(size) / 8, np.log1p(n_words) / 6, np.minimum(share(_LOWER[data]) * size / w, 30) / 10, (n_words == 0).astype(float),
            np.ones(len(first)),
        ], axis=1,
    )
    return own, doc, size


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, and those of the line before and after in the same text (zeros at its ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.concatenate([own, before, after], axis=1)


def _soft(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, y)


def _steps(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line of each text and its number of lines, longest text first."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(doc)))
    order = np.argsort(-n, kind="stable")
    return first[order], n[order]


def forward_backward(score: np.ndarray, doc: np.ndarray, table: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of label 1 for each line, expected transitions (2 x 2), and the log partition sum.

    score is the line's weight for label 1 (label 0 has weight 0); all texts advance together. Transitions
    count as much as `share` says of their first line (else 1).
    """
    first, n = _steps(doc)
    front, back = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # texts with at least t + 1 lines
    for t in range(longest):
        at = first[: active[t]] + t
        front[at, 1] = score[at]
        if t:
            a, b = front[at - 1, 0], front[at - 1, 1]
            front[at, 0] += _soft(a + table[0, 0], b + table[1, 0])
            front[at, 1] += _soft(a + table[0, 1], b + table[1, 1])
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        a, b = back[at + 1, 0], back[at + 1, 1] + score[at + 1]
        back[at, 0] = _soft(table[0, 0] + a, table[0, 1] + b)
        back[at, 1] = _soft(table[1, 0] + a, table[1, 1] + b)
    both = front + back
    log_z = _soft(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    weight = np.stack([np.zeros(len(score)), score], 1)
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(front[inner, i] + table[i, j] + weight[inner + 1, j] + back[inner + 1, j] - log_z[inner]) @ (np.ones(len(inner)) if share is None else share[inner])
    return good, pairs, float(log_z[first].sum()) if len(first) else 0.0


def fit_chain(x: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and the transition table: by Adam, the least mean over documents of minus log likelihood a line, plus a ridge.

    Each document counts once: its lines and their transitions share its weight equally, so long texts don't drown short ones.
    """
    share = 1 / np.bincount(doc)[doc]
    n = doc.max() + 1
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner + 1]), share[inner])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        slope = chain_slope(theta, x, doc, label, share, seen, n) + penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-4], theta[-4:].reshape(2, 2)


def chain_slope(theta: np.ndarray, x: np.ndarray, doc: np.ndarray, label: np.ndarray, share: np.ndarray, seen: np.ndarray, n: int) -> np.ndarray:
    """Gradient of the mean over n documents of minus log likelihood a line."""
    good, pairs, _ = forward_backward(x @ theta[:-4], doc, theta[-4:].reshape(2, 2), share)
    return np.concatenate([x.T @ ((good - label) * share), (pairs - seen).ravel()]) / n


def aggregated(good: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Mean of the lines' marginals in each text, weighted by line length (an empty line counts as one byte)."""
    weight = np.maximum(size, 1)
    return np.bincount(doc, good * weight, n) / np.bincount(doc, weight, n)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibration(quality: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve from document quality to label, by Newton steps (ridge 1e-3)."""
    z = np.stack([_logit(quality), np.ones(len(quality))], 1)
    w = np.array([0.5, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * len(z) * np.eye(2) * 0.01
        w = w - np.linalg.solve(h, z.T @ (p - label) + 1e-5 * len(z) * w)
    return float(max(w[0], 1e-3)), float(w[1])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in blocks(batch.column(1)):
            own, doc, size = line_features(data, at)
            cut = np.searchsorted(doc, np.arange(end - first + 1))
            rows = [own[a:b].astype(np.float32).ravel() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            sizes = [size[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([batch.column(0).slice(first, end - first), pa.array(rows, pa.list_(pa.float32())), pa.array(sizes, pa.list_(pa.int64()))], ["label", "features", "sizes"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, max_bytes: int = MAX_TRAINING_BYTES) -> dict | None:
    """The model of docs(doc_id, text) and labels(doc_id, label): fitted on at most `max_docs` of `max_bytes`.

    Half of the sample may come from each label; texts of over MAX_TRAINING_LINES lines are passed over. Every line of a document is taught as its document's
    label. None if there is no document of either label.
    """
    rows = labelled_sample(docs, labels, {0: max_docs // 2, 1: max_docs // 2}, max_bytes, MAX_TRAINING_LINES)
    sample = rows.select("label", "text").mapInArrow(_emit, "label int, features array<float>, sizes array<long>").toArrow()
    label = sample.column("label").to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        return None
    size = sample.column("sizes").combine_chunks()
    flat = np.asarray(sample.column("features").combine_chunks().flatten(), np.float64).reshape(-1, _FEATURES)
    doc = np.repeat(np.arange(len(label)), np.asarray(size.value_lengths()))
    x = with_neighbours(flat, doc)
    weights, table = fit_chain(x, doc, label[doc])
    quality = aggregated(forward_backward(x @ weights, doc, table)[0], doc, np.asarray(size.flatten()), len(label))
    slope, offset = calibration(quality, label.astype(float))
    return {"weights": weights, "table": table, "slope": slope, "offset": offset}


def text_scores(texts: pa.Array, model: dict | None) -> np.ndarray:
    """Score of each text, 0 to 1; without a model 0.5."""
    if model is None:
        return np.full(len(texts), 0.5)
    out = []
    for first, end, data, at in blocks(texts):
        own, doc, size = line_features(data, at)
        good = forward_backward(with_neighbours(own, doc) @ model["weights"], doc, model["table"])[0]
        z = model["slope"] * _logit(aggregated(good, doc, size, end - first)) + model["offset"]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def scored_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs(row, text) as (row, score). Null and empty texts are one empty line, scored like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(text_scores(batch.column(1), model), pa.float64())], ["row", "score"])

    return docs.select("row", "text").mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, score double")


def taught(labels: DataFrame) -> DataFrame:
    """Labels of documents that aren't held out: crc32(doc_id) mod 5 is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def document_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents.

    Learns labels.quality from rows whose crc32(doc_id) mod 5 is not 0 (null doc_id: held out). Repeated
    rows stay and score alike; labels with null or other values teach nothing, of labels that disagree the
    larger counts; without labels of both kinds every score is 0.5.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = fit_quality(docs, taught(labels.select("doc_id", F.col("quality").alias("label"))))
    scores = scored_quality(rows.select(F.struct("doc_id", "held_out").alias("row"), "text"), model)
    return scores.select("row.doc_id", "row.held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
