"""Near-duplicate removal against brute force over all pairs."""

import os
import random
from collections import Counter, defaultdict

import pytest

from framelake.llm import neardup


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_rows_that_stay(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for edits in (0, 0, 1, 2, 6, 25):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(900, ""), (901, None), (902, " \n"), (3, "z"), (5, "w"), (5, "z"), (None, "z"), (None, "only here"), (None, "only here"), rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in neardup.without_near_duplicates(docs.repartition(3)).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    sets = {t: shingles(t) for _, t in rows}
    texts = sorted({t or "" for _, t in rows})
    root = {t: t for t in texts}
    alike = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if likeness(sets[a] if a else set(), sets[b] if b else set()) >= 0.8]
    for _ in range(8):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    homes = {root[t or ""] for _, t in kept}
    assert homes == set(root.values()) and len(kept) == len(homes)  # no group is lost or left apart
    assert sum(t in ("", None, " \n") for _, t in kept) == 1 and (3, "z") in kept and (5, "w") in kept and (None, "only here") in kept
    assert not {(5, "z"), (None, "z")} & set(kept)


def alike(texts):
    """All pairs of similarity 0.8 or more, by shared shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    shared = Counter()
    for ids in holders.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    return {(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_no_alike_pair_of_the_given_table_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in neardup.without_near_duplicates(docs).select("doc_id").collect()}
    least = {}
    for r in docs.orderBy("doc_id").collect():
        least.setdefault(r["text"] or "", r["doc_id"])
    texts = {i: t for t, i in least.items()}
    assert kept <= set(texts) and not {(a, b) for a, b in alike(texts) if a in kept and b in kept}


def test_an_unlike_first_text_parts_no_pair(spark):
    """Many texts share a passage, and so keys, with an unlike one of the least node; pairs of near copies among them are found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage = [word() for _ in range(120)]
    rows = []
    for i in range(0, 120, 2):
        own = passage + [word() for _ in range(60)]
        rows += [(i, " ".join(own)), (i + 1, " ".join([*own[:-3], word(), word(), word()]))]
    kept = {r["doc_id"] for r in neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 120, 2))


def test_keys_of_many_texts_are_ordered_in_parts(spark):
    texts = spark.createDataFrame([(i, [7, *range(i, i + 15)]) for i in range(500)], "node long, keys array<long>")
    pairs = neardup.key_pairs(texts, chunk=50).collect()
    assert {(0, i) for i in range(1, 500)} <= {(r["a"], r["b"]) for r in pairs} and len(pairs) <= 500 * 3 * neardup.KEYS


def crowded(n_groups, crowd, seed=5):
    """Texts of groups with a passage each: two alike ones (0.82) before `crowd` longer ones, which are like nothing (under 0.8)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(4, 7)))
    texts = []
    for _ in range(n_groups):
        passage = [word() for _ in range(184)]
        texts += [" ".join(passage + [word() for _ in range(own)]) for own in [20, 20] + [40] * crowd]
    return texts


def test_a_crowd_of_unlike_texts_between_parts_no_pair(spark):
    texts = crowded(4, 300)
    sets = [shingles(t) for t in texts]
    pairs = {(a, b) for g in range(0, len(texts), 302) for a in range(g, g + 302) for b in range(g, a) if likeness(sets[a], sets[b]) >= 0.8}
    assert pairs == {(302 * g + 1, 302 * g) for g in range(4)}
    kept = {r["doc_id"] for r in neardup.without_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()}
    assert kept == set(range(len(texts))) - {302 * g + 1 for g in range(4)}


def test_rest_pairs_hold_every_alike_pair_and_cut_large_bins(spark):
    rng = random.Random(3)
    texts = crowded(3, 40) + ["a b c d e", "A b c d e f", "", " \n", "z"]
    for i in (0, 5, 50):  # chains from alike to unlike
        w = texts[i].split()
        for _ in range(15):
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    wanted = {(min(p), max(p)) for p in alike(dict(enumerate(texts)))} | {(128, 129)}
    some = neardup.shingle_sets(rows.toArrow()["text"].combine_chunks(), 5)
    common = max(Counter(int(h) for _, _, sets in some for own in sets for h in own).items(), key=lambda x: x[1])[0]
    sized = neardup.fingerprinted(rows, 5).withColumnRenamed("row", "node").cache()
    none, one = spark.createDataFrame([], "node long, root long"), spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    for frequent in ([], [common]):  # the order is for speed only
        known = (neardup.np.array(frequent, "int64").view("uint64"), neardup.np.full(len(frequent), 9))
        prefixes = neardup.prefixed(rows, 5, 0.8, known).withColumnRenamed("row", "node").cache()
        for size in (neardup.BIN, 7):
            found = {(r["a"], r["b"]) for r in neardup.rest_pairs(prefixes, sized, none, 0.8, size).collect()}
            assert wanted <= found and len(wanted) > 40
        left = {(r["a"], r["b"]) for r in neardup.rest_pairs(prefixes, sized, one, 0.8).collect()}
        assert left == found - {(0, 1)}


def test_wide_parities_keep_alike_long_texts_and_part_others(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BIN", 3)
    rng = random.Random(9)
    texts = []
    for n in (480, 700, 1000, 2040, 4090, 9000):  # at the borders of widths
        base = [f"{n}w{i}" for i in range(n)]
        grown = base + [f"x{rng.random()}" for _ in range(n // 6)]
        edited = [w if i % 60 else "y" for i, w in enumerate(base)]
        texts += [" ".join(w) for w in (base, grown, edited, base[: n // 3] + [f"z{rng.random()}" for _ in range(n // 2)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    common = sorted(int(h) for _, _, sets in neardup.shingle_sets(neardup.pa.array([texts[-4]]), 5) for h in sets[0])[::2]
    sized = neardup.fingerprinted(rows, 5).withColumnRenamed("row", "node")
    known = (neardup.np.sort(neardup.np.array(common, "int64").view("uint64")), neardup.np.full(len(common), 9))
    prefixes = neardup.prefixed(rows, 5, 0.8, known).withColumnRenamed("row", "node")
    found = {(r["a"], r["b"]) for r in neardup.rest_pairs(prefixes, sized, spark.createDataFrame([], "node long, root long"), 0.8).collect()}
    wanted = {(min(p), max(p)) for p in alike(dict(enumerate(texts)))}
    assert len(wanted) >= 12 and wanted <= found and not {p for p in found if p[1] % 4 == 3}
