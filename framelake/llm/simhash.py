"""SimHash near-duplicates: fingerprints, exact Hamming neighbours by vantage-point trees, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.storage import written

#: Points of a shard that are compared without a further split.
LEAF = 256
#: Fingerprints that the trees are grown from: about SAMPLE, or one in SAMPLED where that is more, MOST_SAMPLED at most (8 bytes each).
SAMPLE, SAMPLED, MOST_SAMPLED = 32_768, 1_000, 4_000_000
#: Points that a shard should hold.
SHARD = 8192
_LEAST_SAMPLE = 64


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def text_fingerprint(text: str | None, size: int = 4) -> int:
    """64-bit SimHash of a text's word shingles (repeats included), as a signed long; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    step = min(size, len(words)) - 1
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[step:], strict=False)], np.uint64)
    return majority(hashes)


def simhash(rows: DataFrame, size: int = 4) -> DataFrame:
    """rows(row, text) as (row, fingerprint long). Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [text_fingerprint(t.as_py(), size) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], ["row", "fingerprint"])

    return rows.select("row", "text").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fingerprint long")


def blocks_for(radius: int) -> int:
    """Blocks that the 64 bits are cut into, so that fingerprints within the radius differ in at most one bit of some block."""
    return radius // 2 + 1


def masks(parts: int) -> list[np.uint64]:
    """The 64 bits cut into blocks, each as a mask; one tree is grown over each."""
    return [np.uint64(sum(1 << b for b in range(64 * p // parts, 64 * (p + 1) // parts))) for p in range(parts)]


def ball_split(points: np.ndarray, mask: np.uint64, reach: int, tries: int = 2) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """The vantage point and distance that part the points best: those inside, and those not surely inside.

    Distances count the bits of `mask`. Points within `reach` of the boundary go outside too: by the triangle
    inequality two points at most `reach` apart meet on one side at least. None if no split prunes a tenth.
    """
    best = None
    for at in range(0, len(points), -(-len(points) // tries)):
        far = np.bitwise_count((points ^ points[at]) & mask)
        upto = np.cumsum(np.bincount(far, minlength=65))
        most = np.maximum(upto[reach:], len(points) - upto[: 65 - reach])  # split at reach, reach + 1, ...
        split = int(most.argmin())
        if most[split] <= 0.9 * len(points) and (best is None or most[split] < best[0]):
            best = most[split], points[at], split + reach, far
    if best is None:
        return None
    _, vantage, split, far = best
    return vantage, split, far <= split, far > split - reach


def grown_tree(sample: np.ndarray, mask: np.uint64, reach: int, scale: float, most: int) -> list[tuple[np.uint64, int, int, int]]:
    """Nodes (vantage point, distance, inner, outer) of a tree over a sample in which a point stands for `scale`.

    A child is a node's number, or -1 - number of a shard. Node 0 is the root; no nodes: one shard.
    """
    nodes: list[list] = []
    shards = 0
    todo = [(sample, -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        found = ball_split(own, mask, reach) if len(own) * scale > most and len(own) >= _LEAST_SAMPLE else None
        if parent >= 0:
            nodes[parent][2 + side] = -1 - shards if found is None else len(nodes)
        if found is None:
            shards += 1
            continue
        vantage, split, inside, outside = found
        nodes.append([vantage, split, 0, 0])
        todo += [(own[inside], len(nodes) - 1, 0), (own[outside], len(nodes) - 1, 1)]
    return [tuple(n) for n in nodes]


def routed(points: np.ndarray, tree: list[tuple[np.uint64, int, int, int]], mask: np.uint64, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of the points in it): a branch is pruned where the triangle bound rules it out for a point."""
    todo = [(0 if tree else -1, np.arange(len(points)))]
    while todo:
        number, at = todo.pop()
        if not len(at):
            continue
        if number < 0:
            yield -1 - number, at
            continue
        vantage, split, inner, outer = tree[number]
        far = np.bitwise_count((points[at] ^ vantage) & mask)
        todo += [(inner, at[far <= split]), (outer, at[far > split - reach])]


def tree_links(points: np.ndarray, radius: int, mask: np.uint64, reach: int) -> tuple[np.ndarray, int]:
    """Local root of each fingerprint, and the number of pairs compared.

    All pairs within `radius` whose bits of `mask` differ in at most `reach` are joined: a vantage-point
    tree over the masked bits parts the points; leaves, and nodes that no split prunes, are compared in
    blocks, but for pairs that are joined already (those of a dense cluster are, through their centres).
    """
    root = np.arange(len(points))
    compared = 0

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = find(a), find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))

    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > LEAF:
            found = ball_split(points[at], mask, reach)
            if found is not None:
                todo += [at[found[2]], at[found[3]]]
                continue
            for centre in at[:: max(1, len(at) // 8)]:
                near = at[np.bitwise_count(points[at] ^ points[centre]) <= radius]
                join(near, np.full(len(near), centre))
        tops, size = np.unique(find(at), return_counts=True)
        rest = at[find(at) != tops[size.argmax()]] if len(at) > LEAF else at  # pairs within the largest cluster are joined
        compared += len(rest) * len(at)
        for i in range(0, len(rest), LEAF):
            a, b = np.nonzero(np.bitwise_count(points[rest[i : i + LEAF], None] ^ points[at]) <= radius)
            join(rest[i + a], at[b])
    return find(np.arange(len(points))), compared


def _by_shard(radius: int, blocks: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go over batches. Members of a local cluster are linked in a chain."""
        own = masks(blocks)
        held: list[np.ndarray] = []
        shard = None

        def links() -> pa.RecordBatch:
            points = np.concatenate(held).view(np.uint64)
            top, _ = tree_links(points, radius, own[shard >> 32], reach) if len(points) > 1 else (np.zeros(len(points), np.int64), 0)
            order = np.argsort(top, kind="stable")
            same = top[order][1:] == top[order][:-1]
            sorted_points = points[order].view(np.int64)
            return pa.record_batch([pa.array(sorted_points[:-1][same]), pa.array(sorted_points[1:][same])], ["a", "b"])

        for batch in batches:
            ids, points = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and ids[a] != shard:
                    yield links()
                    held = []
                shard = int(ids[a])
                held.append(points[a:b])
        if held:
            yield links()

    return run


def near_fingerprints(points: DataFrame, radius: int = 4, most: int = SHARD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within the radius.

    Two fingerprints within `radius` differ in at most one bit of one block. Over each block
    a vantage-point tree, grown from a sample that grows with the table up to what a task can be sent, deals all fingerprints into shards of about
    `most`, those near a boundary into the shards on both sides. Each shard goes on with a tree of its own
    and compares what is left. Only chains of links leave a task: fewer than its fingerprints.
    """
    blocks = blocks_for(radius)
    total = points.count()
    wanted = max(SAMPLE, min(total // SAMPLED, MOST_SAMPLED))
    picked = points.where(F.pmod(F.xxhash64("point"), F.lit(max(1, total // wanted))) == 0).limit(2 * wanted)  # distinct points: near `wanted` of them
    sample = np.sort(picked.select("point").toArrow()["point"].to_numpy()).view(np.uint64)
    sample = np.random.default_rng(0).permutation(sample)
    reach = radius // blocks
    trees = [grown_tree(sample, m, reach, total / max(1, len(sample)), most) for m in masks(blocks)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for block, mask in enumerate(masks(blocks)):
                for shard, at in routed(own, trees[block], mask, reach):
                    yield pa.record_batch([pa.array(np.full(len(at), block << 32 | shard)), pa.array(own[at].view(np.int64))], ["shard", "point"])

    dealt = points.select("point").mapInArrow(deal, "shard long, point long").repartition("shard").sortWithinPartitions("shard", "point")
    return dealt.mapInArrow(_by_shard(radius, blocks, reach), "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of documents.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id that links
    reach. Null, blank and shingle-less texts share fingerprint zero and link like any other. Repeated
    rows stay as they are. An empty table gives an empty result.
    """
    prints = simhash(docs.select(F.col("doc_id").cast("long").alias("row"), "text"), size=size)
    prints = written(prints.select(F.col("row").alias("doc_id"), "fingerprint"), "simhash")
    points = written(prints.groupBy(F.col("fingerprint").alias("point")).agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(written(near_fingerprints(points, radius), "links"))
    least = points.join(roots, points["point"] == roots["node"], "left").select("point", "least", F.coalesce("root", "point").alias("root"))
    least = written(least, "rooted")
    linked = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # apart from the join, which may then split a large component
    classes = written(least.join(linked, "root").select(F.col("point").alias("fingerprint"), "component_id"), "classes")
    return prints.join(classes, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
