"""Groups are united where nearly all rows have copies."""

from collections import defaultdict

from framelake.llm import sharding


def test_pairs_are_united_in_full_shards(spark):
    texts = [f"pair {i // 2}" for i in range(1960)] + [f"single {i}" for i in range(40)]
    rows = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    home, held = defaultdict(set), defaultdict(int)
    for r in rows:
        home[texts[r["doc_id"]]].add(r["shard"])
        held[r["shard"]] += 1
    assert len(rows) == 2000 and set(held.values()) == {250}
    split = sum(len(s) > 1 for s in home.values())
    assert split <= 10, split


def test_cut_edges_fall_and_equal_rows_part(spark):
    texts = [f"group {i % 40}" for i in range(400)] + [f"single {i}" for i in range(400)] + ["hot"] * 400
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, "same row")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lambda sizes: sum(n * (sum(v) - n) for v in sizes for n in v) // 2
    found = sharding.balanced_shards(docs, 8).collect()
    held, slots, groups = defaultdict(int), defaultdict(set), defaultdict(lambda: defaultdict(int))
    name = dict(rows)
    for r in found:
        held[r["shard"]] += 1
        slots[r["shard"]].add(r["slot"])
        groups[name[r["doc_id"]]][r["shard"]] += 1
    assert set(held.values()) == {200} and all(s == set(range(200)) for s in slots.values())
    small = [list(v.values()) for k, v in groups.items() if k.startswith("group")]
    spread = [[10 / 8] * 8] * 40  # as dealt at first
    assert cut(small) < 0.1 * cut(spread)
    assert len(groups["same row"]) > 1 and max(groups["same row"].values()) <= 200
