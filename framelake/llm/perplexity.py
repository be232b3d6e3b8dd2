"""Quality rules by n-gram perplexity: modified Kneser-Ney models that Spark counts over all documents.

The models are over UTF-8 bytes: an n-gram of `ORDER` bytes fits a signed long exactly, so its key is its
hash. Texts start after ORDER - 1 zero bytes. Every table entry is a pair (key, value) and the log
probability of a byte is a plain sum of the values of the n-grams and contexts that end there:

    log p(w | h_k) = log p(w | h_k-1) + [log gamma(h_k) if h_k was seen] + [gain(h_k w) if h_k w was seen]

with gain = log p_KN - log gamma - log p of the lower order. So the sorted arrays can be cut by key into
as many pieces as memory asks for, and a document's sums over the pieces add up.

There are two models, each over one half of the texts (dealt by a checksum of the text, so copies stay
together), with one set of discounts. A text is scored by the model that hasn't seen it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.storage import written
from framelake.llm.textarrays import blocks, counts_before, mix, owner, span_hashes, words

ORDER = 5
#: Interquartile ranges outside the quartiles at which a text is no longer kept.
FENCES = 1.75
#: Entries of the models that a task holds at once (12 bytes each); larger models are read in pieces.
PIECE = 8_000_000
#: Counts of a partition that are merged before they are sent on.
FLUSH = 2_000_000
#: Texts that are worked on at once, in bytes.
BLOCK = 2_000_000
#: Bands (one a language) up to which they are sent to every task.
BROADCAST_BANDS = 10_000
#: The base rules: least words, and most per cent of words in repeated windows.
LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: Bits above an n-gram's bytes: the half of the texts that it comes from, and whether a key is a context's.
_HALF = 1 << 8 * ORDER
_CONTEXT = 1 << 8 * ORDER + 1


def tag(order: int) -> int:
    """High bits that tell n-grams of different orders apart."""
    return order << 8 * ORDER + 2


def low(order: int) -> int:
    """Bits of the last `order` bytes."""
    return (1 << 8 * order) - 1


def halves(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 or 1 for each text: the half that it belongs to."""
    raw, at = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return np.array([zlib.crc32(raw[a:b]) >> 7 & 1 for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)


def ending_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Key of the ORDER bytes that end at each byte; bytes before a text's start are zero."""
    key = np.zeros(len(data), np.int64)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(ORDER - 1, -1, -1):
        part = np.zeros(len(data), np.int64)
        part[back:] = data[: max(0, len(data) - back)]
        if back:
            part[since < back] = 0
        key = key << 8 | part
    return key


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def failing(stats: dict[str, np.ndarray], least_words: int, repeat_percent: int) -> np.ndarray:
    """Whether each text fails the base rules."""
    return (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > repeat_percent * stats["n_words"])


def _counter(least_words: int, repeat_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts of the texts that pass the base rules: one row for each n-gram of a partition, more only beyond FLUSH of them."""
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, _, data, at in blocks(batch.column(0), BLOCK):
                fine = ~failing(_text_stats(data, at), least_words, repeat_percent)
                own = np.repeat(np.where(fine, halves(data, at), -1), np.diff(at))
                found = (ending_grams(data, at) | own << 8 * ORDER)[own >= 0]
                found.sort()
                cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                keys.append(found[cut])
                counts.append(np.diff(np.append(cut, len(found))))
                held += len(cut)
                if held > FLUSH:
                    key, n = _merged(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > FLUSH // 2:
                        yield pa.record_batch([pa.array(key), pa.array(n)], ["gram", "n"])
                        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        key, n = _merged(keys, counts)
        if len(key):
            yield pa.record_batch([pa.array(key), pa.array(n)], ["gram", "n"])

    return run


def _discounted(grams: DataFrame, order: int) -> DataFrame:
    """grams(gram, n) with the context, its total and gamma, and the discounted probability."""
    n = F.col("n")
    ones = grams.agg(*[F.sum((n == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in ones)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [min(0.95, max(0.05, x)) for x in (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5)]
    discount = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    gram = F.col("gram")
    context = F.shiftright(gram.bitwiseAND(F.lit(low(order))), 8).bitwiseOR(gram.bitwiseAND(F.lit(_HALF)))
    grams = grams.withColumn("context", context)
    totals = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("kept_back"))
    return grams.join(totals, "context").select("gram", "context", (F.greatest(n - discount, F.lit(0.0)) / F.col("total")).alias("own"), (F.col("kept_back") / F.col("total")).alias("gamma"))


def kneser_ney(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """(key, value) entries of both models, as the module's heading says, of the texts that pass the base rules."""
    counted = docs.select(F.col(text_col)).mapInArrow(_counter(least_words, repeat_percent), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = {ORDER: written(counted, "grams")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct bytes to their left
        grams[k] = grams[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(low(k) | _HALF)).alias("gram")).agg(F.count("*").alias("n"))
        grams[k] = written(grams[k], "grams")
    entries: list[DataFrame] = []
    below: DataFrame | None = None
    for k in range(1, ORDER + 1):
        rows = _discounted(grams[k], k)
        if below is None:
            full = rows.withColumn("gamma", F.col("gamma") / 256)  # of an equal share for every byte
            full = full.withColumn("p", F.col("own") + F.col("gamma")).withColumn("gain", F.log("p") - F.log("gamma"))
        else:
            suffixes = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            full = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(low(k - 1) | _HALF))).join(suffixes, "suffix")
            full = full.withColumn("p", F.col("own") + F.col("gamma") * F.col("lower")).withColumn("gain", F.log("p") - F.log("gamma") - F.log("lower"))
        full = written(full.select("gram", "context", "gamma", "p", "gain"), "model")
        entries.append(full.select((F.col("gram") + F.lit(tag(k))).alias("key"), F.col("gain").cast("float").alias("value")))
        contexts = full.groupBy("context").agg(F.min("gamma").alias("gamma"))
        entries.append(contexts.select((F.col("context") + F.lit(tag(k) + _CONTEXT)).alias("key"), F.log("gamma").cast("float").alias("value")))
        below = full
    model = entries[0]
    for more in entries[1:]:
        model = model.unionByName(more)
    return written(model, "entries")


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(0))


def _gram_scores(keys: np.ndarray, values: np.ndarray, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Sum of the entries of one piece that belong to each of some distinct n-grams: its own, and those of its endings."""
    total = np.zeros(len(grams), np.float64)
    if len(keys) and len(grams):
        total += _lookup(keys, values, grams + tag(order))
        total += _lookup(keys, values, ((grams & low(order)) >> 8 | grams & _HALF) + (tag(order) + _CONTEXT))
        if order > 1:
            shorter, at = np.unique(grams & (low(order - 1) | _HALF), return_inverse=True)
            total += _gram_scores(keys, values, shorter, order - 1)[at]
    return total


def _text_stats(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a block."""
    n = len(at) - 1
    starts, ends, doc = words(data, at)
    lead = counts_before((data & 0xC0) != 0x80)
    hashes = span_hashes(data, starts, ends)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    symbols = counts_before(symbol[data])
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, lead[ends] - lead[starts], n).astype(np.int64), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}
    # lines with a word, equal to an earlier one of their text
    breaks = data == 10
    first = np.union1d(np.flatnonzero(breaks) + 1, at[:-1])
    first = first[first < len(data)]
    inside = owner(at, first)
    stop = np.minimum(np.append(first[1:], len(data)), at[inside + 1]) if len(first) else first
    stop = stop - (breaks[np.maximum(stop - 1, 0)] & (stop > first))
    some = counts_before(np.isin(np.arange(len(data)), starts)) if len(data) else np.zeros(1, np.int64)
    full = some[stop] > some[first]
    first, stop, inside = first[full], stop[full], inside[full]
    lines = span_hashes(data, first, stop)
    order = np.lexsort((lines, inside))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (inside[order][1:] == inside[order][:-1])
    out["n_dup_lines"] = np.bincount(inside[order][again], minlength=n)
    # words in windows of three that come twice or more
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    window = mix(hashes[whole] * np.uint64(3) + mix(hashes[whole + 1] * np.uint64(5) + mix(hashes[whole + 2])))
    order = np.lexsort((window, doc[whole]))
    same = (window[order][1:] == window[order][:-1]) & (doc[whole][order][1:] == doc[whole][order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = np.zeros(len(doc) + 3, bool)
    for j in range(3):
        marked[whole[order][twice] + j] = True
    out["n_repeat_words"] = np.bincount(doc[marked[: len(doc)]], minlength=n)
    return out


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scorer(model, stats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = model.value
        for batch in batches:
            for first, end, data, at in blocks(batch.column(1), BLOCK):
                other = np.repeat(1 - halves(data, at), np.diff(at))
                grams, inverse = np.unique(ending_grams(data, at) | other << 8 * ORDER, return_inverse=True)
                run_up = np.concatenate([[0.0], np.cumsum(_gram_scores(keys, values, grams)[inverse])])
                columns = {"row": batch.column(0).slice(first, end - first), "log_p": pa.array(run_up[at[1:]] - run_up[at[:-1]]), "n_bytes": pa.array(np.diff(at))}
                found = _text_stats(data, at) if stats else {}
                columns |= {k: pa.array(found[k].astype(np.int64)) if stats else pa.nulls(end - first, pa.int64()) for k in _STATS}
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def scored(docs: DataFrame, model: DataFrame, piece: int = PIECE) -> DataFrame:
    """docs(row, text, ...) with log_p, n_bytes and the base rules' counts for each row; repeated rows stay.

    Entries up to `piece` are held by every task, and each text is read once. More are dealt by the half of the texts that they come from, as
    a text needs those of the other half only: a half with up to `piece` entries again takes one reading of its texts, without a shuffle. Of a larger
    half the entries are dealt by a hash of their key; each pass over its texts holds one piece, and the passes are added up for each
    distinct (row, checksum of the text), whose copies have equal sums and are counted and dealt out again.
    """
    if model.count() <= piece:
        return _passes(docs, model, 1)
    half = F.shiftright(F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 7).bitwiseAND(F.lit(1))  # as in `halves`
    out: DataFrame | None = None
    for own in (0, 1):
        entries = model.where(F.col("key").bitwiseAND(F.lit(_HALF)) == (_HALF if own else 0))
        part = _passes(docs.where(half == 1 - own), entries, max(1, -(-entries.count() // piece)))
        out = part if out is None else out.unionByName(part)
    return out


def _passes(docs: DataFrame, model: DataFrame, passes: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["row"].dataType.simpleString()
    whole: DataFrame | None = None
    for i in range(passes):
        rows = model.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == i).toArrow()  # `piece` rows
        keys, values = rows.column("key").to_numpy(), rows.column("value").to_numpy()
        order = np.argsort(keys)
        held = spark.sparkContext.broadcast((keys[order], values[order]))
        if passes == 1:
            schema = f"row {kind}, log_p double, n_bytes long, " + ", ".join(f"{k} long" for k in _STATS)
            return docs.select("row", "text").mapInArrow(_scorer(held, True), schema)
        schema = f"row struct<row:{kind},text:string>, log_p double, n_bytes long, " + ", ".join(f"{k} long" for k in _STATS)
        marked = docs.select(F.struct("row", F.coalesce(F.sha2("text", 256), F.lit("")).alias("text")).alias("row"), "text")
        part = marked.mapInArrow(_scorer(held, i == 0), schema)
        part = part.groupBy("row").agg(F.max("log_p").alias("log_p"), F.count("*").alias("copies"), *[F.max(k).alias(k) for k in ("n_bytes", *_STATS)])
        whole = part if whole is None else whole.unionByName(part)
    added = whole.groupBy("row").agg(F.sum("log_p").alias("log_p"), F.max("copies").alias("copies"), *[F.max(k).alias(k) for k in ("n_bytes", *_STATS)])
    dealt = added.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return dealt.select("row.row", "log_p", "n_bytes", *_STATS)


def banded(table: DataFrame, value: str, length: str, fences: float) -> DataFrame:
    """table(lang, base_failed, ...) with `lower` and `upper` of each row's language (null is one of its own).

    The band goes `fences` interquartile ranges over the quartiles of the texts that pass the base rules.
    Quartiles are exact ones of values rounded to four places, so they don't depend on partitions.
    Squared deviations (cut at three ranges, so that junk doesn't teach them) are fitted as a + b / length;
    a text shorter than the median is given the band times the root of what that fit says for it.
    """
    fine = table.where("not base_failed")
    quarter = F.percentile(F.round(value, 4), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    bands = fine.groupBy(F.col("lang").alias("band_lang")).agg(quarter.alias("q"), F.percentile(length, F.lit(0.5)).alias("usual"))
    bands = bands.withColumn("range", F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.01)))
    same = F.col("lang").eqNullSafe(F.col("band_lang"))
    off = F.least(F.abs(F.col(value) - F.col("q")[1]), 3 * F.col("range"))
    share = 1 / F.greatest(F.col(length), F.lit(1))
    bands = written(bands, "bands")
    few = bands.count() <= BROADCAST_BANDS  # a row a language
    fits = fine.join(F.broadcast(bands) if few else bands, same).groupBy(F.col("lang").alias("fit_lang")).agg(F.regr_slope(off * off, share).alias("b"), F.regr_intercept(off * off, share).alias("a"))
    bands = written(bands.join(fits, F.col("band_lang").eqNullSafe(F.col("fit_lang"))), "bands")
    a, b = F.greatest("a", F.lit(0.0)), F.greatest("b", F.lit(0.0))
    usual = a + b / F.greatest(F.col("usual"), F.lit(1))
    grown = F.when((b > 0) & (usual > 0), F.greatest(F.lit(1.0), F.sqrt((a + b * share) / usual))).otherwise(F.lit(1.0))
    wide = F.col("range") * fences * grown
    judged = table.join(F.broadcast(bands) if few else bands, same, "left").withColumn("lower", F.col("q")[0] - wide).withColumn("upper", F.col("q")[2] + wide)
    return judged.drop("band_lang", "fit_lang", "q", "usual", "range", "a", "b")


def rule_verdicts(docs: DataFrame, fences: float = FENCES, least_words: int = LEAST_WORDS, repeat_percent: int = REPEAT_PERCENT, piece: int = PIECE) -> DataFrame:
    """(doc_id, counts, base_failed, kept, perplexity, lower, upper) for every row of documents.

    base_failed: under `least_words` words, or over `repeat_percent` per cent of the words in repeated
    windows. Among the rest of each language (null is a language of its own), texts whose log perplexity
    a byte lies over `fences` interquartile ranges outside the quartiles are not kept. Null and empty
    texts fail the base rules; rows are judged one by one, so repeated rows have equal verdicts. A mean
    over few bytes varies more, so bands widen for short texts, by as much as length explains. Only texts
    that pass the base rules teach the models; where the other half of the texts is empty, all log
    perplexities are 0. An empty table gives an empty result.
    """
    model = kneser_ney(docs, least_words=least_words, repeat_percent=repeat_percent)
    rows = docs.select(F.struct("doc_id", "lang").alias("row"), "text")
    table = scored(rows, model, piece).select("row.doc_id", "row.lang", F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes")).alias("bits"), "n_bytes", *_STATS)
    failed: Column = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    table = written(table.withColumn("base_failed", failed), "scores")
    judged = banded(table, "bits", "n_bytes", fences)
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(False))
    return judged.select("doc_id", *_STATS, "base_failed", kept.alias("kept"), F.exp("bits").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"))
