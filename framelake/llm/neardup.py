"""Near-duplicate removal: texts of near SimHash or with shared least hashes of five-word shingles as first candidates, then all pairs that these leave apart; exact similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.simhash import majority, near_fingerprints
from framelake.llm.storage import written
from framelake.llm.textarrays import blocks, mix, shingle_hashes, span_hashes, words

#: Independent fingerprints of a text; a pair is a candidate if one of them is near.
HASHES = 1
#: Keys of a text, each of two least shingle hashes; texts of similarity 0.8 share one of them but for a chance of 1e-7, and SHARED of them but for 3e-6.
KEYS, SHARED = 16, 2
#: Texts with the same key that one task puts in order.
CHUNK = 10_000
#: Documents whose shingles tell which are frequent, one in SAMPLE_OF where that is more, and the most of these that tasks know. They set an order only.
SAMPLE, SAMPLE_OF, MOST_FREQUENT = 8_192, 64, 500_000
#: Bits of a set's parities, and of those that pairs are held against before whole sets meet; bits in which two sets differ are at most the values that one of them lacks.
PARITIES, WIDE = 512, 4_096
#: Texts of a bin that are compared with as many others of it at a time.
BIN = 4_096
#: Texts of a bin that isn't parted by size.
SMALL_BIN = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """First and end row of each block of texts, and the sorted distinct hashes of each text's word shingles (A-Z lower-cased)."""
    for first, end, data, at in blocks(texts):
        data = _LOWER[data]
        starts, ends, doc = words(data, at)
        hashes, doc = shingle_hashes(span_hashes(data, starts, ends), doc, end - first, size)
        cut = np.searchsorted(doc, np.arange(end - first + 1))
        yield first, end, [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def least_keys(own: np.ndarray) -> np.ndarray:
    """KEYS hashes of two shingles each: the least ones in 2 KEYS bins of their hash (an empty bin takes the next one's)."""
    if not len(own):
        return np.zeros(KEYS, np.int64)
    hashes = np.sort(mix(own.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    bits = np.uint64(64 - (2 * KEYS - 1).bit_length())
    first = hashes[np.searchsorted(hashes, np.arange(2 * KEYS, dtype=np.uint64) << bits) % len(hashes)]
    return mix(first[0::2] + mix(first[1::2] + np.arange(KEYS, dtype=np.uint64))).view(np.int64)


def parities(own: np.ndarray, bits: int) -> np.ndarray:
    """For each of `bits` places whether an odd number of hashes falls on it, as longs."""
    filled = np.bincount((mix(own.view(np.uint64)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((filled & 1).astype(np.uint8)).view(np.int64)


def fingerprinted(rows: DataFrame, size: int, hashes: int = HASHES) -> DataFrame:
    """rows(row, text) as (row, fingerprints, keys, n, parities, more): SimHashes of the distinct shingles under independent hashes, their least_keys, number and parities; more of these for large sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, sets in shingle_sets(batch.column(1), size):
                prints = [[majority(mix(own.view(np.uint64) + np.uint64(k)) if k else own.view(np.uint64)) for k in range(hashes)] for own in sets]
                keys = pa.array([least_keys(own) for own in sets], pa.list_(pa.int64()))
                n, odd = pa.array([len(own) for own in sets], pa.int64()), pa.array([parities(own, PARITIES) for own in sets], pa.list_(pa.int64()))
                more = pa.array([parities(own, min(1 << (len(own) - 1).bit_length(), 2 * WIDE)) if len(own) > PARITIES else [] for own in sets], pa.list_(pa.int64()))
                columns = [batch.column(0).slice(first, end - first), pa.array(prints, pa.list_(pa.int64())), keys, n, odd, more]
                yield pa.record_batch(columns, ["row", "fingerprints", "keys", "n", "parities", "more"])

    return rows.select("row", "text").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fingerprints array<long>, keys array<long>, n long, parities array<long>, more array<long>")


def with_shingles(rows: DataFrame, size: int) -> DataFrame:
    """rows(row, text) as (row, shingles array<long>, wide array<long>): the shingles and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, sets in shingle_sets(batch.column(1), size):
                wide = pa.array([parities(own, WIDE) for own in sets], pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0).slice(first, end - first), pa.array(sets, pa.list_(pa.int64())), wide], ["row", "shingles", "wide"])

    return rows.select("row", "text").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, shingles array<long>, wide array<long>")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct values of two arrays of distinct values; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every > 0, shared / every).otherwise(F.lit(1.0))


def may_be_alike(differ: Column, n: Column, m: Column, similarity: float) -> Column:
    """False only where sets of n and m values whose parities differ in that many bits can't have the similarity."""
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (differ * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6)


def bits_apart(x: Column, y: Column) -> Column:
    """Bits in which two arrays of parities differ; of one twice as wide the halves are laid over each other, null for other widths or none."""
    half = lambda a, b: F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda u, v: u.bitwiseXOR(v))).otherwise(a)
    apart = F.aggregate(F.zip_with(half(x, y), half(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    fit = (F.size(x) > 0) & (F.size(x) == F.size(y)) | (F.size(y) > 0) & (F.size(x) == 2 * F.size(y)) | (F.size(x) > 0) & (F.size(y) == 2 * F.size(x))
    return F.when(fit, apart)


def key_pairs(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) nodes to be compared, of texts(node, keys), that share a key: each with the least node that has the key, and with the two before it in the order of the next keys.

    In that order texts that share several keys stand side by side, so an unlike least node parts few pairs. A key of more than `chunk`
    nodes is ordered in parts. At most 3 KEYS pairs a text, whatever the number of texts with its keys: these unite large groups of copies
    in a few links, and unlinked pairs are left to rest_pairs.
    """
    later = lambda d: F.get("keys", F.pmod(F.col("i") + d, F.lit(KEYS)))
    rows = texts.select("node", "keys", F.posexplode("keys").alias("i", "key")).select("node", "i", "key", later(1).alias("second"), later(2).alias("third"))
    first = rows.groupBy("i", "key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(first, ["i", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk)))
    order = Window.partitionBy("i", "key", "part").orderBy("second", "third", "node")
    rows = rows.withColumns({"before": F.lag("node", 1).over(order), "earlier": F.lag("node", 2).over(order)})
    pairs = rows.select("node", F.explode(F.array("least", "before", "earlier")).alias("other")).where("other is not null and other <> node")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def sharing(pairs: DataFrame, texts: DataFrame, least: int = SHARED) -> DataFrame:
    """The pairs of which `least` keys at the same place are equal, as nearly all pairs of similarity 0.8 have (3e-6 of them have fewer)."""
    keys = lambda name: texts.select(F.col("node").alias(name), F.col("keys").alias(f"{name}_keys"))
    both = pairs.join(keys("a"), "a").join(keys("b"), "b")
    return both.where(F.size(F.filter(F.zip_with("a_keys", "b_keys", lambda x, y: x == y), lambda same: same)) >= least).select("a", "b")


def candidate_links(texts: DataFrame, radius: int, hashes: int = HASHES) -> DataFrame:
    """Links (a, b) between the nodes of texts(node, fingerprints) that join all nodes with a near or equal fingerprint."""
    links: DataFrame | None = None
    for k in range(hashes):
        own = texts.select(F.col("fingerprints")[k].alias("point"), "node")
        points = written(own.groupBy("point").agg(F.min("node").alias("first")), "points")
        same = own.join(points, "point").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
        near = written(near_fingerprints(points.select("point"), radius), "links")
        near = near.join(points.select(F.col("point").alias("a"), F.col("first").alias("x")), "a").join(points.select(F.col("point").alias("b"), F.col("first").alias("y")), "b")
        own = same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
        links = own if links is None else links.unionByName(own)
    return written(links, "candidate-links")


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the shingles that several documents of a sample hold, MOST_FREQUENT at most."""
    step = min(max(docs.count() // SAMPLE, 1), SAMPLE_OF)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(step)) == 0).select(F.col("doc_id").alias("row"), "text")
    counts = with_shingles(sample, size).select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "frequent")
    known = least = 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("shingles")).collect(), key=lambda r: -r["n"]):
        known += r["shingles"]
        if known > MOST_FREQUENT:
            break
        least = r["n"]
    table = counts.where(F.col("n") >= least).toArrow() if least else pa.table({"shingle": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    hashes = table["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], table["n"].to_numpy()[order]


def prefixed(rows: DataFrame, size: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows(row, text) as (row, prefix array<long>): the first of a text's shingles.

    The order, frequent shingles last, is the same for all texts. Of two texts that share `similarity` of all their shingles each holds a common one among
    its first n - ceil(similarity * n) + 1, so prefixes lose no such pair, whatever the sample. A text without shingles has 0 in their place.
    """
    held = rows.sparkSession.sparkContext.broadcast(frequent)

    def first_of(own: np.ndarray) -> np.ndarray:
        hashes, counts = held.value
        if not len(own):
            return np.zeros(1, np.int64)
        often = np.zeros(len(own), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own.view(np.uint64)), len(hashes) - 1)
            often = np.where(hashes[at] == own.view(np.uint64), counts[at], 0)
        return own[np.argsort(often, kind="stable")[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, sets in shingle_sets(batch.column(1), size):
                yield pa.record_batch([batch.column(0).slice(first, end - first), pa.array([first_of(own) for own in sets], pa.list_(pa.int64()))], ["row", "prefix"])

    return rows.select("row", "text").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, prefix array<long>")


def rest_pairs(prefixes: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, size: int = BIN) -> DataFrame:
    """(a, b) of prefixes(node, prefix), once a node, and texts(node, n, parities, more): every pair that can have the similarity and that roots(node, root) leave apart.

    A bin is a shingle that prefixes of several roots hold; of bins with the same nodes one is enough. All pairs of a bin are compared whose
    numbers of shingles allow the similarity; those stay whose parities do. Bins of more than `size` nodes are cut into parts,
    every part against every one, so no task compares a large bin whole.
    """
    beside = Window.partitionBy("shingle").orderBy("node")
    shared = prefixes.select("node", F.explode("prefix").alias("shingle")).withColumns({"before": F.lag("node").over(beside), "after": F.lead("node").over(beside)})
    shared = written(shared.where("before is not null or after is not null").select("shingle", "node"), "shared")
    rooted = shared.join(roots, "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("root"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    bins = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"), *marks).where("low <> high")
    bins = written(bins.groupBy("held", "mark0", "mark1").agg(F.min("shingle").alias("shingle")).select("shingle", "held"), "bins")
    # texts of similar size are of the same class or of neighbouring ones; small bins have one
    width = math.log(1 / min(similarity, 0.99)) * (1 + 1e-9)
    level = F.when(F.col("held") > SMALL_BIN, F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(width))).otherwise(F.lit(0).cast("long"))
    words = [F.col("parities")[k].alias(f"p{k}") for k in range(PARITIES // 64)]
    members = rooted.join(bins, "shingle").join(texts.select("node", "n", "more", *words), "node").withColumn("level", level)
    members = written(members, "members")
    parts = F.ceil(F.col("held") / size)
    own, every = F.pmod(F.xxhash64("node"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    a = members.select("*", own.alias("i"), every.alias("j")).alias("a")
    b = members.select("*", F.explode(F.when(F.col("held") > SMALL_BIN, F.array("level", F.col("level") - 1)).otherwise(F.array("level"))).alias("met"), own.alias("j")).select("*", every.alias("i")).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("shingle", "i", "j")]
    once = (F.col("a.level") < F.col("b.level")) | (F.col("a.node") < F.col("b.node"))
    differ = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(PARITIES // 64)), F.lit(0))
    may = (F.col("a.root") != F.col("b.root")) & may_be_alike(differ, F.col("a.n"), F.col("b.n"), similarity)
    may = may & F.coalesce(may_be_alike(bits_apart(F.col("a.more"), F.col("b.more")), F.col("a.n"), F.col("b.n"), similarity), F.lit(True))
    met = a.join(b, [*same, F.col("a.level") == F.col("b.met"), once & may])
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def alike_links(docs: DataFrame, texts: DataFrame, pairs: DataFrame, size: int, similarity: float, grown: bool = True) -> DataFrame:
    """Those pairs(a, b) of texts(node, text_key, least) whose exact similarity is enough; `grown`: their number grows with the table, so no task is sent all.

    Whole sets meet only where their parities can be alike.
    """
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    ends = written(pairs.selectExpr("a as node").union(pairs.selectExpr("b as node")).distinct().join(texts, "node").select("node", "text_key", "least"), "ends")
    of = ends.hint("merge") if grown else ends
    ended = docs.select("doc_id", "text", key.alias("_key")).join(of, (F.col("_key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("least")))
    sets = with_shingles(ended.select(F.col("node").alias("row"), "text"), size).withColumnRenamed("row", "node")
    sets = written(sets.dropDuplicates(["node"]).withColumn("n", F.size("shingles")), "shingles")
    both = lambda of, c: of.join(sets.select(F.col("node").alias("a"), *[F.col(x).alias(f"a_{x}") for x in c]), "a").join(sets.select(F.col("node").alias("b"), *[F.col(x).alias(f"b_{x}") for x in c]), "b")
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    close = written(both(pairs, ("wide", "n")).where(may_be_alike(differ, F.col("a_n"), F.col("b_n"), similarity)).select("a", "b"), "close")
    return written(both(close, ("shingles",)).where(jaccard(F.col("a_shingles"), F.col("b_shingles")) >= similarity).select("a", "b"), "links")


def without_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 8) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of equal or near-equal texts, that of the smallest doc_id.

    First candidates are pairs of texts whose SimHash fingerprints of `size`-word shingles differ in `radius` or fewer bits
    (see near_fingerprints), and pairs with a common key (see key_pairs), where SHARED keys are equal; then all pairs that can be alike and
    that links so far leave apart (see rest_pairs), so no link between groups is lost. Those whose exact Jaccard
    similarity is `similarity` or more are linked, and of texts that links connect one stays. Texts are told apart by their MD5, rows by doc_id and text, so a doc_id that is
    repeated with another text is a row of its own. Null texts count as empty, and texts without words are
    alike. Rows without a doc_id come after all others; of repeated rows one stays; an empty table gives
    an empty result.
    """
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    prints = fingerprinted(docs.select(F.struct("doc_id", key.alias("text_key")).alias("row"), "text"), size)
    prints = written(prints.select("row.*", "fingerprints", "keys", "n", "parities", "more"), "fingerprints")
    rows = prints.groupBy("text_key", "doc_id").agg(F.count("*").alias("copies"), F.first(F.struct("fingerprints", "keys", "n", "parities", "more")).alias("own"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copies")).alias("least")
    texts = rows.groupBy("text_key").agg(F.first("own").alias("own"), least)
    texts = texts.select("text_key", F.xxhash64("text_key").alias("node"), "own.*", F.col("least.doc_id").alias("least"), (F.col("least.copies") > 1).alias("repeated"))
    texts = written(texts, "texts")
    near = candidate_links(texts, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(key_pairs(texts).union(near).distinct(), "key-pairs")
    pairs = written(sharing(pairs, texts), "pairs")
    roots = connected_components(alike_links(docs, texts, pairs, size, similarity))
    rows = docs.select(F.xxhash64(key).alias("row"), "text")
    prefixes = prefixed(rows, size, similarity, frequent_shingles(docs, size)).withColumnRenamed("row", "node").dropDuplicates(["node"])
    rest = written(rest_pairs(prefixes, texts, roots, similarity), "rest")
    if not rest.isEmpty():
        links = alike_links(docs, texts, rest, size, similarity, grown=False)
        roots = connected_components(links.union(roots.select("root", "node")))
    groups = texts.join(roots, "node").select("root", "text_key", F.struct(F.col("least").isNull().alias("none"), "least", "text_key").alias("order"))
    groups = written(groups, "groups")
    first = written(groups.groupBy("root").agg(F.min("order").alias("first")).select("first.text_key"), "first")
    gone = groups.select("text_key").join(first, "text_key", "left_anti")
    kept = texts.join(gone, "text_key", "left_anti").select(F.col("text_key").alias("_kept_key"), F.col("least").alias("_kept_least"), F.col("repeated").alias("_kept_repeated"))
    kept = written(kept, "kept")
    # always a merge join: the kept texts grow with the input, so they are never sent to every task
    joined = docs.withColumn("_key", key).join(kept.hint("merge"), (F.col("_key") == F.col("_kept_key")) & F.col("doc_id").eqNullSafe(F.col("_kept_least")))
    once = joined.where("not _kept_repeated").select(*docs.columns)
    if kept.where("_kept_repeated").isEmpty():
        return once
    return once.unionByName(joined.where("_kept_repeated").select(*docs.columns, "_key").dropDuplicates(["doc_id", "_key"]).select(*docs.columns))
