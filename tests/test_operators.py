"""Operators over frames on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import backup, colors, detections, frames, maintenance, search, statistics, times
from framelake.operators.embedding import hash_embedding
from framelake.schemas import OBJECT

FRAME = f"seq long, id string, timestamp double, source_clip string, wall_time double, camera string, labels array<string>, objects array<{OBJECT.simpleString()}>, counts map<string,bigint>, embedding array<float>, text_embedding array<float>, tags array<string>, detection_confidence double"


def vec(text):
    return hash_embedding([text])[0].tolist()


def obj(label, color="red", size="small"):
    return {"label": label, "confidence": 0.9, "bbox": [0.0, 0.0, 1.0, 1.0], "area": 1.0, "color_hex": None, "color_name": color, "size": size}


def table(spark, rows):
    base = {"timestamp": 0.0, "source_clip": "c", "wall_time": None, "camera": "default", "labels": [], "objects": [], "counts": {}, "embedding": vec("x"), "text_embedding": [], "tags": [], "detection_confidence": 0.0}
    names = [f.split()[0] for f in ("seq", "id", *base)]
    full = [{"seq": i, **base, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FRAME)


def ask(spark, text, **more):
    return spark.createDataFrame([("q", text, *more.values())], ", ".join(["query_id string", "text string", *[{"labels": "labels array<string>", "start_time": "start_time double", "end_time": "end_time double"}[k] for k in more]]))


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_semantic_order(spark):
    t = table(spark, [{"id": "dog", "embedding": vec("blue dog"), "labels": ["dog"]}, {"id": "car", "embedding": vec("red car"), "labels": ["car"]}])
    found = search.hybrid_search(t, ask(spark, "red car"))
    assert ids(found)[0] == "car" and found.first()["score"] > 0


def test_label_penalty_keeps_rows(spark):
    t = table(spark, [{"id": "e2", "embedding": vec("vehicle"), "labels": ["dog"]}, {"id": "e1", "embedding": vec("vehicle"), "labels": ["car"]}])
    assert ids(search.hybrid_search(t, ask(spark, "hello there", labels=["car"]))) == ["e1", "e2"]


def test_one_object_must_hold_all(spark):
    t = table(spark, [{"id": "split", "objects": [obj("car", "gray"), obj("truck", "purple")]}, {"id": "whole", "objects": [obj("truck", "gray")]}])
    rows = {r["id"]: r for r in search.hybrid_search(t, ask(spark, "gray truck")).collect()}
    assert rows["whole"]["rank"] == 1 and rows["split"]["structure"] == 0.5 and rows["split"]["color_match"] == 0.0


def test_dominance_and_size(spark):
    t = table(spark, [{"id": "one", "objects": [obj("car")]}, {"id": "three", "objects": [obj("car")] * 3}])
    assert ids(search.hybrid_search(t, ask(spark, "car")))[0] == "three"
    t = table(spark, [{"id": "large", "objects": [obj("dog", size="large")]}, {"id": "small", "objects": [obj("dog")]}])
    assert ids(search.hybrid_search(t, ask(spark, "small dog")))[0] == "small"


def test_votes_demote_text(spark):
    t = table(spark, [{"id": "a", "embedding": vec("blue dog"), "text_embedding": vec("red car truck person")}])
    before = search.hybrid_search(t, ask(spark, "red car")).first()["semantic"]
    votes = spark.createDataFrame([("a", "down"), ("a", "up"), ("a", "meh"), ("zz", "down")], "entry_id string, vote string")
    after = search.hybrid_search(maintenance.apply_votes(t, votes), ask(spark, "red car")).first()["semantic"]
    assert after < 0.75 * before
    assert {(r["entry_id"], r["reason"]) for r in maintenance.rejected_votes(t, votes).collect()} == {("a", "vote"), ("zz", "unknown id")}


def test_blank_query_and_sorts(spark):
    t = table(spark, [{"id": "a", "wall_time": 5.0}, {"id": "b", "wall_time": 9.0}, {"id": "n"}])
    assert search.hybrid_search(t, ask(spark, "  ")).count() == 0
    assert ids(search.hybrid_search(t, ask(spark, "car"), sort="newest")) == ["b", "a", "n"]
    assert ids(search.hybrid_search(t, ask(spark, "car"), sort="oldest")) == ["n", "a", "b"]
    assert ids(search.hybrid_search(t, ask(spark, "car", start_time=5.0, end_time=5.0))) == ["a"]


def test_batch_is_one_by_one_and_prefix(spark):
    rng = np.random.default_rng(3)
    t = table(spark, [{"id": f"f{i}", "objects": [obj(rng.choice(["car", "dog", "bus"]), rng.choice(["red", "blue"])) for _ in range(rng.integers(0, 4))], "embedding": vec(str(rng.choice(["red car", "blue dog", "bus"]))), "detection_confidence": float(rng.random())} for i in range(60)])
    texts = ["red car", "blue", "small dog", "anything"]
    batch = spark.createDataFrame([(x, x) for x in texts], "query_id string, text string")
    whole = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in search.hybrid_search(t.repartition(7), batch, top_k=8, tie_decimals=6).collect()}
    for x in texts:
        for r in search.hybrid_search(t, batch.where(F.col("query_id") == x), top_k=5, tie_decimals=6).collect():
            assert whole[x, r["rank"]] == (r["id"], round(r["score"], 9))


def test_store_search_has_no_floor(spark):
    v = spark.createDataFrame([(0, "a", [-1.0, 0.0], [-1.0, 0.0]), (1, "b", [-1.0, 0.0], None), (2, "c", [0.5, 0.5], None)], "seq long, id string, embedding array<float>, text_embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<float>")
    rows = search.store_search(v, q, 5, encoder=None, query_vector_col="v").orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 4)) for r in rows] == [("c", 0.7071), ("b", 0.0), ("a", -1.0)]


def test_label_search(spark):
    t = table(spark, [{"id": "e1", "labels": ["person", "car"]}, {"id": "e2", "labels": ["dog"]}, {"id": "e3", "labels": ["person", "person"]}])
    q = spark.createDataFrame([("p", ["person"]), ("r", ["person", "person", "car"])], "query_id string, labels array<string>")
    got = {(r["query_id"], r["id"]): round(r["score"], 4) for r in search.query_by_labels(t, q).collect()}
    assert got == {("p", "e1"): 1.0, ("p", "e3"): 1.0, ("r", "e1"): 0.6667, ("r", "e3"): 0.3333}


def test_time_filters(spark):
    t = table(spark, [{"id": "a", "timestamp": 5.0, "wall_time": 1.0}, {"id": "b", "timestamp": 15.0}, {"id": "c", "timestamp": 25.0, "wall_time": 3.0}])
    assert [r["id"] for r in frames.query_by_time(t, 10, 20).collect()] == ["b"]
    assert {r["id"] for r in frames.filter_wall_time(t, 1.0, 3.0).collect()} == {"a", "c"} and frames.filter_wall_time(t).count() == 3
    assert [r["id"] for r in frames.tail_rows(t, 2).collect()] == ["b", "c"] and frames.tail_rows(t, 0).count() == 3
    assert [r["id"] for r in frames.page(t, 2).collect()] == ["a", "b"] and [r["id"] for r in frames.page(t, 1, 1, compat=True).collect()] == ["c"]


def test_nearest_time(spark):
    base = 1_757_700_000.0
    t = table(spark, [{"id": "e1", "wall_time": base}, {"id": "e2", "wall_time": base + 12}, {"id": "e3", "wall_time": base + 47}, {"id": "n"}])
    assert [(r["id"], r["delta"]) for r in times.nearest_time(t, base + 10, 2).collect()] == [("e2", 2.0), ("e1", 10.0)]
    assert times.nearest_time(t, None).count() == 0 and times.nearest_time(t, base, None).count() == 3


@pytest.mark.parametrize("bucket", [16, 20_000])
def test_nearest_batch_is_brute_force(spark, bucket, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(times, "_EVERY", 2)
    rows = [(i, f"f{i}", None if i % 50 == 0 else 500.0 if i % 3 == 0 else rng.choice([rng.uniform(0, 1000), float(rng.randrange(20)), 700 + rng.random() / 5000]), [x for x in ("car", "dog", "bus") if rng.random() < 0.3]) for i in range(600)]
    frames_ = spark.createDataFrame(rows, "seq long, id string, wall_time double, labels array<string>")
    ask_ = [(i, rng.choice([500.0, 700.0, 700.0001, rng.uniform(-50, 1100)]), rng.choice([None, [], ["car"], ["dog", "bus", "dog"], ["cow"]]), rng.choice([None, 1, 3, 40, 0])) for i in range(120)] + [(900, None, None, 2)]
    targets_ = spark.createDataFrame(ask_, "target_id int, t double, labels array<string>, top_k int")

    def want(k_default):
        out = []
        for i, t, labels, top in ask_:
            k = top if top is not None else k_default
            near = sorted((math.floor(abs(w - t) * 1e4 + 0.5) / 1e4, s, f) for s, f, w, own in rows if t is not None and w is not None and (not labels or set(labels) & set(own)))
            out += [(i, n + 1, s, f, d) for n, (d, s, f) in enumerate(near[:k])]
        return out

    for k in (4, None):
        got = sorted((r["target_id"], r["rank"], r["seq"], r["id"], r["delta"]) for r in times.nearest_time_batch(frames_, targets_, k, bucket=bucket, asked=7).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want(k)] and all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want(k), strict=True))
    plain = times.nearest_time_batch(frames_.drop("labels"), targets_.select("target_id", "t"), 2)
    assert plain.count() == 240 and times.nearest_time_batch(frames_.limit(0), targets_, 2).count() == 0
    assert times.nearest_time_batch(frames_, targets_.limit(0), 2).count() == 0


def test_range_join(spark):
    t = table(spark, [{"id": f"f{i}", "wall_time": float(i * 10)} for i in range(20)])
    r = spark.createDataFrame([("a", 10.0, 30.0), ("b", 185.0, 500.0), ("c", 9.0, 1.0)], "range_id string, start double, end double")
    got = {}
    for x in times.range_join(t, r).collect():
        got.setdefault(x["range_id"], set()).add(x["id"])
    assert got == {"a": {"f1", "f2", "f3"}, "b": {"f19"}}


def test_detections(spark):
    schema = "frame_id string, det_idx int, label string, confidence double, bbox array<double>, frame_area double, color_hex string, color_name string"
    d = spark.createDataFrame([("f", 1, "person", 0.9, [0.0, 0.0, 50.0, 50.0], 10000.0, None, "red"), ("f", 2, "car", 0.7, [0.0, 0.0, 50.0, 50.0], 10000.0, None, "blue"), ("f", 3, "dog", 0.4, [0.0, 0.0, 50.0, 50.0], 10000.0, None, "red"), ("f", 4, "car", 0.9, [0.0, 0.0, 2.0, 2.0], 10000.0, None, "red"), ("f", 5, "car", 0.9, [0.0, 0.0, 1.0, 1.0], 0.0, None, "red")], schema)
    kept = detections.keep_detections(d)
    assert sorted(r["det_idx"] for r in kept.collect()) == [1, 2, 5]
    f = spark.createDataFrame([("f",), ("g",)], "id string")
    rows = {r["id"]: r for r in detections.assemble_frames(detections.sized(kept.where("det_idx < 5")), f).collect()}
    assert rows["f"]["labels"] == ["person", "car"] and rows["f"]["counts"] == {"person": 1, "car": 1} and rows["f"]["detection_confidence"] == 0.8
    assert rows["g"]["labels"] == [] and rows["g"]["detection_confidence"] == 0.0 and rows["f"]["tags"] == ["blue car", "car", "large car", "large person", "person", "red person"]
    with pytest.raises(ValueError):
        detections.keep_detections(d, ["unicorn"])


def test_statistics(spark):
    t = table(spark, [{"id": "e1", "source_clip": "a", "counts": {"person": 2, "car": 1}, "objects": [obj("person"), obj("person"), obj("car", "blue")], "camera": ""}, {"id": "e2", "source_clip": "a", "counts": {"person": 1}, "objects": [obj("person", "green")], "detection_confidence": 0.85}, {"id": "e3", "source_clip": "b", "labels": ["dog", "dog"]}, {"id": "e4", "source_clip": "z"}])
    s = statistics.index_stats(t).first()
    assert (s["total_frames"], s["total_clips"], s["total_objects"], s["avg_detection_confidence"], s["cameras"]) == (4, 3, 4, 0.85, "default")
    assert {r["label"]: r["n"] for r in statistics.label_counts(t).collect()} == {"person": 3, "car": 1, "dog": 2}
    assert {r["color"]: r["n"] for r in statistics.color_counts(t).collect()} == {"red": 2, "blue": 1, "green": 1}
    assert {(r["clip"], r["label"]): r["n"] for r in statistics.clip_counts(t).collect()} == {("a", "person"): 3, ("a", "car"): 1, ("b", "dog"): 1, ("z", None): 0}
    assert statistics.index_stats(t.limit(0)).first()["total_frames"] == 0


def test_upsert_and_descriptions(spark):
    t = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "a", "3")], "seq long, id string, v string")
    c = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("n", "z", 5), ("m", "w", 5), ("k", "u", 9)], "id string, v string, change_order long")
    assert sorted((r["seq"], r["id"], r["v"]) for r in maintenance.upsert_frames(t, c).collect()) == [(0, "a", "y"), (1, "b", "2"), (2, "a", "3"), (3, "m", "w"), (4, "n", "z"), (5, "k", "u")]
    d = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("q", "lost", 1), ("b", "Description unavailable: x", 1)], "entry_id string, description string, ts long")
    rows = maintenance.apply_descriptions(t, frames.storable_descriptions(d)).collect()
    assert {r["id"]: r["description"] for r in rows} == {"a": "new", "b": None}
    assert [r["entry_id"] for r in maintenance.rejected_descriptions(t, d).collect()] == ["q"]


def test_backup_round_trip(spark):
    data = [("a", bytes(range(256)) * 20), ("b", b"short"), ("c", b"")]
    a = spark.createDataFrame(data, "archive_id string, data binary")
    chunks = backup.chunk_split(a, chunk=100).select("archive_id", F.col("idx").alias("read_order"), "payload")
    back = {r["archive_id"]: r for r in backup.reassemble(chunks.unionByName(chunks).unionByName(spark.createDataFrame([("a", 999, "bad"), ("b", 999, "x/y|z")], chunks.schema))).collect()}
    assert bytes(back["a"]["data"]) == data[0][1] and back["b"]["status"] == "complete" and "c" not in back
    most = backup.reassemble(chunks.where("read_order <> 3")).where("archive_id = 'a'").first()
    few = backup.reassemble(chunks.where("read_order < 3")).where("archive_id = 'a'").first()
    assert (most["status"], most["data"], few["status"]) == ("partial", None, "failed")


def test_sessions_touching_gap(spark):
    s = spark.createDataFrame([("c", 0.0, 0.5), ("c", 2.0, 0.5), ("c", 4.1, 0.5), ("c", 3.0, 0.02)], "camera string, t double, score double").select("camera", F.timestamp_seconds("t").alias("ts"), "score")
    rows = times.motion_sessions(s).orderBy("start_ts").collect()
    assert [r["n_frames"] for r in rows] == [2, 1]
    assert times.motion_sessions(s, min_duration=1.0).count() == 1


@pytest.mark.parametrize(("bgr", "name"), [((0, 0, 255), "red"), ((0, 255, 0), "green"), ((255, 0, 0), "blue"), ((0, 255, 255), "yellow"), ((255, 255, 0), "cyan"), ((0, 165, 255), "orange"), ((128, 0, 128), "purple"), ((0, 0, 0), "black"), ((255, 255, 255), "white"), ((128, 128, 128), "gray")])
def test_solid_colors(bgr, name):
    image = np.full((100, 100, 3), bgr, np.uint8)
    got, shade = colors.dominant_color(image, [0, 0, 100, 100])
    assert got == name and shade.startswith("#")


def test_color_regions():
    image = np.zeros((100, 100, 3), np.uint8)
    image[:, :50], image[:, 50:] = (0, 0, 255), (255, 0, 0)
    assert colors.dominant_color(image, [0, 0, 50, 100])[0] == "red" and colors.dominant_color(image, [50, 0, 100, 100])[0] == "blue"
    assert colors.dominant_color(image, [0, 0, 2, 2]) == ("unknown", None)
    image[:] = (255, 0, 0)
    assert colors.dominant_color(image, [-50, -50, 500, 500])[0] == "blue"


def test_retention_and_plans(spark):
    rows = spark.createDataFrame([("alerts", 0.0), ("alerts", 90.0), ("other", 0.0)], "class string, age_ts double")
    policy = spark.createDataFrame([("alerts", 0)], "class string, days int")
    assert {(r["class"], r["age_ts"]) for r in frames.apply_retention(rows, policy, 90.0).collect()} == {("alerts", 90.0), ("other", 0.0)}
    assert frames.expired(rows, policy, 90.0).count() == 1
    clips = spark.createDataFrame([("a",), ("b",)], "clip string")
    plan = frames.sampling_plan(clips, clips.where("clip = 'a'"))
    assert [r["ts"] for r in plan.orderBy("ts").collect()] == list(range(0, 60, 5))


def test_chunks_beyond_the_total_do_not_count(spark):
    rows = [("a", 0, "0/3|QUJD"), ("a", 1, "1/3|REVG"), ("a", 2, "7/3|R0hJ"), ("b", 0, "0/1|QUJD"), ("b", 1, "5/1|R0hJ")]
    chunks = spark.createDataFrame(rows, "archive_id string, read_order long, payload string")
    strict = {r["archive_id"]: (r["status"], r["n_chunks"]) for r in backup.reassemble(chunks).collect()}
    assert strict == {"a": ("failed", 2), "b": ("complete", 1)}
    assert {r["archive_id"]: r["status"] for r in backup.reassemble(chunks, compat=True).collect()} == {"a": "complete", "b": "complete"}


def test_small_frame_operators(spark):
    t = table(spark, [{"id": "a", "camera": "", "labels": ["car", "yeti"]}, {"id": "a", "camera": "x"}])
    assert frames.get_frame(t, "a").first()["camera"] == "" and frames.get_frame(t, "q").count() == 0
    assert [(r["id"], r["unsupported"]) for r in frames.unsupported_labels(t).collect()] == [("a", ["yeti"])]
    row = t.limit(1).select(frames.split_labels(F.lit("a, b,,")).alias("x")).first()
    assert row["x"] == ["a", "b"]
    times_ = spark.createDataFrame([(0.0, 5.0, 1.0), (None, 5.0, 1.0), (None, None, 1.0)], "given_wall_time double, derived_wall_time double, timestamp double")
    assert [r["wall_time"] for r in frames.wall_times(times_).collect()] == [1.0, 6.0, None]


def test_searches_of_recent_frames(spark):
    t = table(spark, [{"id": f"e{i}", "wall_time": float(i), "labels": ["car"], "embedding": vec("red car"), "text_embedding": vec("red car")} for i in range(6)])
    asked = spark.createDataFrame([("q", "red car", ["car"])], "query_id string, text string, labels array<string>")
    late = {"e4", "e5"}
    assert {r["id"] for r in search.query_by_labels(t, asked, recent_n=2).collect()} == late
    assert {r["id"] for r in search.store_search(t, asked, recent_n=2).collect()} == late
    assert {r["id"] for r in times.nearest_time(t, 0.0, recent_n=2).collect()} == late
    assert {r["id"] for r in search.hybrid_search(t, asked, recent_n=2).collect()} == late
