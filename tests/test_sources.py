"""Readers, writers and streams."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framelake.operators import colors, times
from framelake.operators.embedding import detect_frames
from framelake.sources import files, table
from framelake.streaming import jobs


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


FRAME = {"id": "a", "timestamp": 10.0, "source_clip": "c.mp4", "thumbnail_path": "t.jpg"}


def test_frames(spark, tmp_path):
    path = lines(tmp_path / "f.jsonl", [FRAME | {"extra": True, "labels": ["person"]}, "", "{broken", {"id": "b"}, FRAME | {"id": "c", "timestamp": "x"}, FRAME | {"id": "d", "objects": [{"label": "car"}]}])
    rows = {r["id"]: r for r in files.read_frames(spark, path).collect()}
    assert set(rows) == {"a", "d"}
    assert rows["a"]["labels"] == ["person"] and rows["a"]["camera"] == "default" and rows["a"]["embedding"] == [] and rows["d"]["objects"][0]["label"] == "car"
    assert files.count_lines(spark, path) == 5


def test_append_frames(spark, tmp_path):
    source = files.read_frames(spark, lines(tmp_path / "f.jsonl", [FRAME | {"wall_time": 90_000.0}]))
    for _ in range(2):
        table.append_frames(source, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2 and (tmp_path / "table/camera=default/day=1970-01-02").exists()


def test_vectors_in_both_layouts(spark, tmp_path):
    path = lines(tmp_path / "v.jsonl", [{"id": "a", "vector": [1.0], "metadata": {"text_vector": [2.0], "camera": "x", "clip": 'say "hi"', "n": 7}}, {"id": "b", "vector": [], "embedding": [3.0], "text_embedding": [4.0]}, "nope"])
    rows = {r["id"]: r for r in files.read_vectors(spark, path).collect()}
    assert (rows["a"]["embedding"], rows["a"]["text_embedding"], rows["a"]["camera"]) == ([1.0], [2.0], "x")
    assert (rows["b"]["embedding"], rows["b"]["text_embedding"]) == ([3.0], [4.0])
    files.append_vectors(files.read_vectors(spark, path), str(tmp_path / "out"))
    again = {r["id"]: r for r in files.read_vectors(spark, str(tmp_path / "out")).collect()}
    assert {k: (r["embedding"], r["text_embedding"], r["camera"], r["metadata"]) for k, r in again.items()} == {"a": ([1.0], [2.0], "x", {"camera": "x", "clip": 'say "hi"', "n": "7"}), "b": ([3.0], [4.0], None, {})}
    files.append_vectors(spark.createDataFrame([("c", [5.0], [])], "id string, embedding array<float>, text_embedding array<float>"), str(tmp_path / "plain"))
    assert files.read_vectors(spark, str(tmp_path / "plain")).first()["embedding"] == [5.0]


def test_events(spark, tmp_path):
    path = lines(tmp_path / "e.jsonl", [{"camera": f"c{i}", "timestamp": "t"} for i in range(5)])
    assert [r["camera"] for r in files.read_events(spark, path, 2).collect()] == ["c3", "c4"]
    files.append_events(spark.createDataFrame([("c", None), ("d", "then")], "camera string, timestamp string"), str(tmp_path / "log"))
    stamps = {r["camera"]: r["timestamp"] for r in files.read_events(spark, str(tmp_path / "log"), None).collect()}
    assert stamps["d"] == "then" and stamps["c"].endswith("+00:00")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_events(spark, lines(tmp_path / "bad.jsonl", ["{broken"])).collect()


def test_motion_log(spark, tmp_path):
    path = lines(tmp_path / "m.txt", ["[x] pts_time: 1.5 y", "pts_time:3.2", "lavfi.scene_score=0.1 lavfi.scene_score=0.15", "pts_time: soon", "nothing"])
    rows = files.read_motion_log(spark, path).collect()
    assert sorted(r["ts"] for r in rows if r["ts"]) == [1.5, 3.2] and [r["score"] for r in rows if r["score"]] == [0.15]


def png(path, bgr, side=20):
    raw = b"".join(b"\0" + bytes(bgr[::-1]) * side for _ in range(side))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_and_files(spark, tmp_path):
    (tmp_path / "img").mkdir()
    png(tmp_path / "img/red.png", (0, 0, 255))
    (tmp_path / "img/broken.png").write_bytes(b"no image")
    images = files.read_images(spark, str(tmp_path / "img"))
    paths = {r["frame_path"].rsplit("/", 1)[1]: r["frame_path"] for r in images.collect()}
    boxes = spark.createDataFrame([(paths["red.png"], [0.0, 0.0, 20.0, 20.0]), (paths["broken.png"], [0.0, 0.0, 20.0, 20.0]), ("lost", [0.0] * 4)], "frame_path string, bbox array<double>").withColumn("color_name", F.lit(None)).withColumn("color_hex", F.lit(None))
    found = {r["frame_path"]: (r["color_name"], r["color_hex"]) for r in colors.annotate_colors(boxes, images).collect()}
    assert found[paths["red.png"]] == ("red", "#ff0000") and found[paths["broken.png"]] == (None, None) == found["lost"]
    assert files.list_files(spark, str(tmp_path / "img")).count() == 2
    assert detect_frames(images.withColumn("frame_id", F.col("frame_path"))).count() == 0


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in/1.json", [FRAME, "{broken"])
    for name in ("2.json", "3.json"):
        jobs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        lines(tmp_path / "in" / name, [FRAME | {"id": name}])
    jobs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["2.json", "3.json", "a"]


def test_stream_ingest_without_repeated_ids(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in/1.json", [FRAME | {"wall_time": 100.0}, FRAME | {"wall_time": 101.0}, FRAME | {"id": "b", "wall_time": 102.0}])
    jobs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), dedupe="1 hour").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_stream_sessions_are_batch_sessions(spark, tmp_path):
    rows = [("c", t, 0.5) for t in (0.0, 2.0, 4.5, 100.0, 101.0, 300.0)]
    df = spark.createDataFrame(rows, "camera string, t double, score double").select("camera", F.timestamp_seconds("t").alias("ts"), "score")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got: list = []
    stream = jobs.live_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    jobs.for_each_batch(stream, lambda b, _: got.extend(b.collect()), str(tmp_path / "check"), "append").awaitTermination()
    want = {(r["start_ts"], r["end_ts"], r["n_frames"]) for r in times.motion_sessions(df).collect()}
    seen = {(r["start_ts"], r["end_ts"], r["n_frames"]) for r in got}
    assert len(want) == 4 and seen == {w for w in want if w[0].timestamp() < 300}  # the last is still open


def test_stream_votes_counts_and_retention(spark, tmp_path):
    spark.createDataFrame([("a", "down"), ("a", "down"), ("b", "up")], "entry_id string, vote string").coalesce(1).write.parquet(str(tmp_path / "v"))
    kind = "labels array<string>, counts map<string,bigint>, objects array<struct<color_name:string>>, tags array<string>, wall_time double"
    spark.createDataFrame([(["car", "car"], {}, [("red",), (None,)], ["red car"], 5.0), (["dog"], {"dog": 3}, [], [], None)], kind).coalesce(1).write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([("x", 0.0), ("x", 86_400.0 * 3)], "class string, age_ts double").coalesce(1).write.parquet(str(tmp_path / "r"))
    out: dict = {}
    votes = spark.readStream.schema("entry_id string, vote string").parquet(str(tmp_path / "v"))
    jobs.for_each_batch(jobs.down_votes(votes), lambda b, _: out.update({r["entry_id"]: r["downs"] for r in b.collect()}), str(tmp_path / "c1")).awaitTermination()
    seen = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "l"))
    jobs.for_each_batch(jobs.running_counts(seen()), lambda b, _: out.update({(r["kind"], r["key"]): r["n"] for r in b.collect()}), str(tmp_path / "c2"), "complete").awaitTermination()
    assert out == {"a": 2, ("label", "car"): 2, ("label", "dog"): 3, ("color", "red"): 1, ("tag", "red car"): 1}
    jobs.for_each_batch(jobs.running_bounds(seen()), lambda b, _: out.update(b.first().asDict()), str(tmp_path / "c4"), "complete").awaitTermination()
    assert [out[k] for k in ("total_frames", "total_objects", "time_min", "time_max")] == [2, 3, 5.0, 5.0]
    policy = spark.createDataFrame([("x", 2)], "class string, days int")
    rows = spark.readStream.schema("class string, age_ts double").parquet(str(tmp_path / "r"))
    jobs.for_each_batch(rows, jobs.retain_batch(policy, str(tmp_path / "kept")), str(tmp_path / "c3"), "append").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1
