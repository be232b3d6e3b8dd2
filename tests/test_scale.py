"""Forms for large tables against plain ones: deep pages, ranges of any length, ranks of all frames, numbering, hooks, boxes, segments."""

import base64
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.operators import backup, colors, embedding, frames, maintenance, times
from framelake.sources import files

PIXELS = "struct<height:int,width:int,nChannels:int,data:binary>"


@pytest.mark.parametrize("spread", [1, 1_000_003])
def test_deep_pages_and_tails(spark, monkeypatch, spread):
    monkeypatch.setattr(frames, "FEW", 20)
    monkeypatch.setattr(frames, "RANGES", 8)
    rng = random.Random(spread)
    seqs = sorted(rng.sample(range(-300, 3000), 700))
    values = [s * spread for s in seqs]
    df = spark.createDataFrame([(v, f"f{v}") for v in values], "seq long, id string").repartition(5)
    for limit, offset in ((5, 0), (30, 0), (7, 400), (50, 680), (10, 699), (10, 700), (10, 5000), (0, 100), (700, 0)):
        assert [r["seq"] for r in frames.page(df, limit, offset).collect()] == values[offset : offset + limit], (limit, offset)
        tail = values[-(limit + offset) :] if limit + offset else values
        assert [r["seq"] for r in frames.page(df, limit, offset, compat=True).collect()] == tail[offset : offset + limit], (limit, offset)
    for n in (1, 19, 21, 333, 700, 900):
        assert [r["seq"] for r in frames.tail_rows(df, n).collect()] == values[-n:]
    assert frames.tail_rows(df, 0).count() == 700 and frames.page(df.limit(0), 50, 100).count() == 0
    low, high, before = frames.seq_range(df, 400)
    assert before <= 400 < before + sum(low <= v < high for v in values) <= before + 20


def test_a_deep_page_sorts_few_rows(spark):
    df = spark.range(200_000).select((F.col("id") * 3).alias("seq"))
    found = frames.page(df, 50, 150_000)
    assert [r["seq"] for r in found.collect()] == [3 * i for i in range(150_000, 150_050)]
    low, high, _ = frames.seq_range(df, 150_000)
    assert df.where((F.col("seq") >= low) & (F.col("seq") < high)).count() <= frames.FEW


def test_ranges_of_any_length(spark):
    rng = random.Random(4)
    moments = [rng.choice([rng.uniform(-2e6, 9e8), float(rng.randrange(-50, 5000)), rng.uniform(0, 3)]) for _ in range(900)]
    rows = [(i, f"f{i}", m) for i, m in enumerate(moments)] + [(5000, "none", None), (5001, "nan", float("nan"))]
    asked = []
    for i in range(120):
        start = rng.choice([rng.uniform(-3e6, 9e8), float(rng.randrange(-50, 5000)), rng.choice(moments)])
        asked.append((i, start, start + rng.choice([0.0, 0.3, 1.0, 15.0, 16.0, 100.0, 5000.0, 1e6, 4e8])))
    asked += [(200, None, 100.0), (201, 100.0, None), (202, None, None), (203, 10.0, 5.0), (204, 1e12, None), (205, float("-inf"), float("inf"))]
    frames_ = spark.createDataFrame(rows, "seq long, id string, wall_time double")
    ranges = spark.createDataFrame(asked, "range_id int, start double, end double")
    got = sorted((r["range_id"], r["seq"]) for r in times.range_join(frames_, ranges).collect())
    want = sorted((i, s) for i, a, b in asked for s, m in enumerate(moments) if (a is None or m >= a) and (b is None or m <= b))
    assert got == want
    assert times.range_join(frames_, ranges.limit(0)).count() == 0 == times.range_join(frames_.limit(0), ranges).count()


def test_covers_are_small_and_exact(spark):
    rng = random.Random(5)
    rows = [(a, a + rng.choice([0, 1, 15, 16, 17, 255, 4096, 10**6, 10**8])) for a in [rng.randrange(-(10**9), 10**9) for _ in range(60)]]
    out = spark.createDataFrame(rows, "a long, b long").select("a", "b", times.covering_blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    for r in out:
        spans = sorted((b["block"] * 16 ** b["level"], (b["block"] + 1) * 16 ** b["level"]) for b in r["blocks"])
        assert spans[0][0] == r["a"] and spans[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(spans[:-1], spans[1:], strict=True)) and len(spans) < 32 * times.SIZES


def test_all_frames_for_many_targets(spark, monkeypatch):
    monkeypatch.setattr(times, "MOST_UNLIMITED", 3)
    monkeypatch.setattr(maintenance, "PARTS", 7)
    monkeypatch.setattr(maintenance, "ROWS", 20)
    rng = random.Random(6)
    rows = [(i, f"f{i}", rng.choice([float(rng.randrange(9)), rng.uniform(0, 9)])) for i in range(150)]
    targets = [(i, rng.uniform(0, 9)) for i in range(8)] + [(None, 4.0)]
    got = sorted(((r["target_id"], r["rank"], r["id"]) for r in times.nearest_time_batch(spark.createDataFrame(rows, "seq long, id string, wall_time double"), spark.createDataFrame(targets, "target_id int, t double"), None).collect()), key=str)
    want = sorted(((i, n + 1, f) for i, t in targets for n, (_, _, f) in enumerate(sorted((round(abs(w - t), 4), s, f) for s, f, w in rows))), key=str)
    assert got == want


def test_numbering_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "PARTS", 9)
    monkeypatch.setattr(maintenance, "ROWS", 20)
    monkeypatch.setattr(maintenance, "LOOKED_AT", 3)
    rng = random.Random(7)
    rows = [(rng.choice([None, "x", "y", f"v{rng.randrange(50)}"]), i, rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "o string, t int, g string").repartition(6)
    order = lambda r: ("" if r[0] is None else "v" + r[0], r[1])
    assert {r["t"]: r["_place"] for r in maintenance.numbered(df, "o", "t").collect()} == {r[1]: n for n, r in enumerate(sorted(rows, key=order))}
    own = {r["t"]: r["_place"] for r in maintenance.numbered(df, "o", "t", by="g").collect()}
    assert own == {r[1]: n for g in "ab" for n, r in enumerate(sorted((r for r in rows if r[2] == g), key=order))}
    assert maintenance.numbered(df.limit(0), "o", "t").count() == 0


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    seen = str(tmp_path)

    def factory():
        open(os.path.join(seen, f"{os.getpid()}-{np.random.default_rng().integers(1 << 60)}"), "w").close()

        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "bad" if i == 40 else None if i == 41 else "x" * i) for i in range(200)], "i int, text string").repartition(8)
    for _ in range(2):
        rows = {r["i"]: r["v"] for r in embedding.embed_column(df, "text", "v", batch=32, factory=factory).collect()}
    assert all(rows[i] == [float(i), 1.0] for i in range(200) if i not in (40, 41)) and rows[41] == [0.0, 1.0]
    assert rows[40] == embedding.hash_embedding(["bad"])[0].tolist()  # and none of its neighbours
    loads = [f.split("-")[0] for f in os.listdir(seen)]
    assert len(loads) == len(set(loads)) > 0


def test_a_detector_with_a_bad_image(spark, tmp_path):
    def factory():
        def detect(batch):
            if (batch["width"] == 13).any():
                raise ValueError("odd image")
            return pd.DataFrame({"frame_id": batch["frame_id"], "det_idx": 0, "label": "car", "confidence": 0.9, "bbox": [[0.0, 0.0, float(w), 4.0] for w in batch["width"]], "frame_area": batch["height"] * batch["width"] * 1.0})

        return detect

    rows = [(f"f{i}", None if i == 5 else (4, 13 if i == 3 else i + 1, 3, b"0")) for i in range(9)]
    images = spark.createDataFrame(rows, f"frame_id string, image {PIXELS}")
    got = {r["frame_id"]: r["bbox"][2] for r in embedding.detect_frames(images, factory=factory).collect()}
    assert got == {f"f{i}": float(i + 1) for i in range(9) if i not in (3, 5)}
    assert embedding.detect_frames(images, factory()).count() == 7 and embedding.detect_frames(images).count() == 0


@pytest.mark.parametrize("boxes", [5, colors.BOXES])
def test_boxes_meet_their_image_without_moving_it(spark, boxes):
    rng = np.random.default_rng(2)
    pixels = {f"p{i}": rng.integers(0, 256, (20, 24, 3), dtype=np.uint8) for i in range(6)}
    images = spark.createDataFrame([(p, (20, 24, 3, x.tobytes())) for p, x in pixels.items()] + [("broken", (20, 24, 3, b"1")), ("none", None)], f"frame_path string, image {PIXELS}")
    rows = [(i, rng.choice([*pixels, "broken", "none", "lost"]).item(), [float(x) for x in rng.uniform(-5, 30, 4)], "old") for i in range(60)] + [(100, "p1", None, "old"), (101, None, [0.0] * 4, "old"), (102, "p1", [1.0], "old"), (103, "p2", [0.0, 0.0, 24.0, 20.0], "old"), (104, "p2", [0.0, 0.0, 24.0, 20.0], "old")]
    found = colors.annotate_colors(spark.createDataFrame(rows, "n int, frame_path string, bbox array<double>, color_name string"), images, boxes)
    got = {r["n"]: (r["color_name"], r["color_hex"]) for r in found.collect()}
    want = {n: colors.dominant_color(pixels[p], b) if p in pixels and b and len(b) == 4 else (None, None) for n, p, b, _ in rows}
    assert got == want and len(set(want.values())) > 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange ")[1:]:
        assert "image" not in part.split("\n")[0]


def test_files_of_a_part_are_chosen_before_they_are_opened(spark, tmp_path):
    for name in ("a b.png", "c+d.png", "é.png"):
        (tmp_path / name).write_bytes(b"no image")
    images = files.read_images(spark, str(tmp_path))
    paths = sorted(r["frame_path"].rsplit("/", 1)[1] for r in images.collect())
    assert paths == ["a b.png", "c+d.png", "é.png"]
    one = images.where(F.col("frame_path").endswith("a b.png")).select("image")
    assert one.count() == 1 and len(one.rdd.glom().collect()) >= 1


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("segment", [4, 100, backup.SEGMENT])
def test_segments_are_the_archive(spark, segment, compat, monkeypatch):
    monkeypatch.setattr(backup, "RUN", 3)
    rng = random.Random(9)
    archives = [(i, rng.randbytes(rng.choice([0, 1, 2, 3, 50, 700]))) for i in range(25)]
    whole = backup.chunk_split(spark.createDataFrame(archives, "archive_id int, data binary"), chunk=17).select("archive_id", F.col("idx").alias("read_order"), "payload")
    lost = whole.where("not (archive_id % 5 = 1 and read_order = 1) and not (archive_id % 5 = 2 and read_order % 2 = 0)")
    odd = spark.createDataFrame([(100, 1, "0/2|QUJ"), (100, 2, "1/2|DRA=="), (101, 1, "0/1|*bad*"), (102, 1, "0/1|"), (100, 3, "9/2|zzzz"), (103, 5, "0/3|QUJD")], "archive_id int, read_order long, payload string")
    chunks = lost.unionByName(lost.where("read_order % 3 = 0").withColumn("read_order", F.col("read_order") + 1000)).unionByName(odd)
    want = {r["archive_id"]: r for r in backup.reassemble(chunks, compat).collect()}
    status = {r["archive_id"]: r for r in backup.archive_status(chunks, compat).collect()}
    assert {k: tuple(r)[:5] for k, r in want.items()} == {k: tuple(r) for k, r in status.items()} and {r["status"] for r in want.values()} == {"complete", "partial", "failed"}
    got: dict = {}
    for r in backup.reassemble_segments(chunks, segment, compat).orderBy("archive_id", "offset").collect():
        got.setdefault(r["archive_id"], []).append((r["offset"], r["data"]))
    for k, r in want.items():
        if r["data"]:
            assert b"".join(d for _, d in got[k]) == r["data"] and [o for o, _ in got[k]] == list(range(0, len(r["data"]), segment // 4 * 3))
        elif r["data"] is None and k != 101 and not compat:
            assert k not in got
    assert any(d is None for _, d in got[101])
    assert base64.b64encode(want[24]["data"] or b"") is not None
    with pytest.raises(ValueError, match="four"):
        backup.reassemble_segments(chunks, 10)
