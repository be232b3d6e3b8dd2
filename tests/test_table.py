"""The index as a table: batches that run again, changes that rewrite only what they touch, swaps that are cut short, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from framelake.operators import search
from framelake.operators.embedding import embed_frames, hash_embedding
from framelake.sources import files, table
from framelake.streaming import jobs

DAY = 86_400.0
FRAME = {"timestamp": 10.0, "source_clip": "c.mp4", "thumbnail_path": "t.jpg"}


def frames(spark, rows):
    """(seq, id, camera, wall_time) rows as frames."""
    df = spark.createDataFrame(rows, "seq long, id string, camera string, wall_time double")
    return df.withColumns({"timestamp": F.lit(1.0), "source_clip": F.lit("c"), "thumbnail_path": F.lit("t"), "tags": F.array(F.lit("red car"))})


def start(spark, path):
    table.append_frames(frames(spark, [(0, "a", "x", 10.0), (1, "b", "x", DAY), (2, "a", "y:+ 1", 20.0), (3, "n", "", None), (4, "e", "x", 5 * DAY)]), path, "first")
    return path


def stored(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def facts(spark, path, *columns):
    return sorted((tuple(r) for r in table.read_index(spark, path).select(*columns).collect()), key=str)


def test_append_and_batches_that_run_again(spark, tmp_path):
    path = start(spark, str(tmp_path / "t"))
    for _ in range(2):
        table.append_frames(frames(spark, [(0, "z", "x", 10.0), (1, "y", "w", None)]), path, "second")
    assert facts(spark, path, "seq", "id", "camera") == [(0, "a", "x"), (1, "b", "x"), (2, "a", "y:+ 1"), (3, "n", "default"), (4, "e", "x"), (5, "z", "x"), (6, "y", "w")]
    assert (tmp_path / "t/camera=x/day=1970-01-02/batch=first").exists()
    table.append_frames(frames(spark, [(0, "z", "x", 11.0)]), path, "second")  # a batch that has become smaller
    assert [r for r in facts(spark, path, "seq", "id") if r[0] > 4] == [(5, "z")]
    built = frames(spark, [(0, "q", "x", 1.0), (0, "p", "x", 2.0)]).drop("seq").withColumn("timestamp", F.col("wall_time"))
    table.append_frames(built, path)
    assert [r for r in facts(spark, path, "seq", "id") if r[0] > 5] == [(6, "q"), (7, "p")]
    assert table.read_index(spark, str(tmp_path / "none")).count() == 0


def test_votes_count_once_and_touch_only_their_folders(spark, tmp_path):
    path = start(spark, str(tmp_path / "t"))
    before = stored(path)
    votes = spark.createDataFrame([("a", "down"), ("a", "down"), ("b", "up"), ("zz", "down"), (None, "down")], "entry_id string, vote string")
    for _ in range(3):
        table.store_votes(spark, path, votes, "v", 7)
    assert facts(spark, path, "seq", "id", "feedback_downvotes") == [(0, "a", 2), (1, "b", None), (2, "a", 2), (3, "n", None), (4, "e", None)]
    after = stored(path)
    assert len(set(before.items()) & set(after.items())) == 3 and len(after) == 5 and all("camera=x/day=1970-01-01" in f or "camera=y" in f for f in set(before) - set(after))
    table.store_votes(spark, path, votes, "v", 8)
    table.store_votes(spark, path, votes, "other", 0)
    table.store_votes(spark, path, votes, "v", 8)
    assert facts(spark, path, "id", "feedback_downvotes")[0] == ("a", 6)


@pytest.mark.parametrize("moves", range(4))
def test_a_swap_that_was_cut_short(spark, tmp_path, monkeypatch, moves):
    path = start(spark, str(tmp_path / "t"))
    votes = spark.createDataFrame([("a", "down"), ("b", "down")], "entry_id string, vote string")
    whole, done = table._move, []

    def failing(*args):
        if len(done) == moves:
            raise OSError("lost")
        done.append(args)
        whole(*args)

    monkeypatch.setattr(table, "_move", failing)
    with pytest.raises(OSError, match="lost"):
        table.store_votes(spark, path, votes, "v", 0)
    monkeypatch.setattr(table, "_move", whole)
    table.store_votes(spark, path, votes, "v", 0)
    assert facts(spark, path, "seq", "id", "feedback_downvotes") == [(0, "a", 1), (1, "b", 1), (2, "a", 1), (3, "n", None), (4, "e", None)]
    assert not [d for d in os.listdir(path) if d.startswith("_") and d != "_SUCCESS"]


def test_descriptions(spark, tmp_path):
    path = start(spark, str(tmp_path / "t"))
    before = stored(path)
    rows = [("b", "old words", 1), ("b", "blue bus", 2), ("e", "Description unavailable: x", 3), ("zz", "lost", 1)]
    for _ in range(2):
        table.store_descriptions(spark, path, spark.createDataFrame(rows, "entry_id string, description string, ts int"), hash_embedding)
    found = {r["id"]: r for r in table.read_index(spark, path).collect()}
    assert found["b"]["description"] == "blue bus" and found["e"]["description"] is None and found["b"]["text_embedding"] == hash_embedding(["blue bus"])[0].tolist()
    assert len(set(before.items()) & set(stored(path).items())) == 4


def test_upserts_keep_their_place_and_may_move(spark, tmp_path):
    path = start(spark, str(tmp_path / "t"))
    changed = frames(spark, [(0, "a", "moved", 3 * DAY), (0, "new2", "x", 10.0), (0, "b", "x", DAY), (0, "new1", "x", None), (0, "b", "late", DAY)]).drop("seq")
    order = F.when(F.col("id") == "new1", 0).when(F.col("camera") == "late", 9).otherwise(5)
    before = stored(path)
    for _ in range(2):
        table.store_changes(spark, path, changed.withColumn("change_order", order), "up-1")
    want = [(0, "a", "moved"), (1, "b", "late"), (2, "a", "y:+ 1"), (3, "n", "default"), (4, "e", "x"), (5, "new1", "x"), (6, "new2", "x")]
    assert facts(spark, path, "seq", "id", "camera") == want
    assert len(set(before.items()) & set(stored(path).items())) == 3


def test_retention(spark, tmp_path):
    path = start(spark, str(tmp_path / "t"))
    table.append_frames(frames(spark, [(0, "late", "x", DAY + 50.0)]), path, "second")
    for _ in range(2):
        table.store_retention(spark, path, 31 * DAY + 40.0, 30)
    assert facts(spark, path, "id") == [("e",), ("late",), ("n",)]
    assert not (tmp_path / "t/camera=x/day=1970-01-01/batch=first").exists() and not (tmp_path / "t/camera=x/day=1970-01-02/batch=first").exists()


def lines(path, name, rows, when):
    (path / name).write_text("".join(json.dumps(FRAME | r) + "\n" for r in rows))
    os.utime(path / name, (when, when))


def test_streams_end_in_an_index_that_searches_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "t")
    run = lambda: jobs.ingest(spark, str(tmp_path / "in"), path, str(tmp_path / "c")).awaitTermination()
    lines(tmp_path / "in", "z.json", [{"id": f"z{i}", "tags": ["dog"]} for i in range(30)], 1000)
    lines(tmp_path / "in", "a.json", [{"id": f"a{i}", "tags": ["red car"]} for i in range(5)], 2000)
    run()
    lines(tmp_path / "in", "0.json", [{"id": "last", "tags": ["red car"]}], 500)
    run()
    want = [f"z{i}" for i in range(30)] + [f"a{i}" for i in range(5)] + ["last"]
    assert [r["id"] for r in table.read_index(spark, path).orderBy("seq").collect()] == want
    index = embed_frames(table.read_index(spark, path))
    q = spark.createDataFrame([("q", "red car")], "query_id string, text string")
    assert [r["id"] for r in search.hybrid_search(index, q, top_k=3).orderBy("rank").collect()] == ["a0", "a1", "a2"]
    spark.createDataFrame([("a0", "down"), ("a0", "down"), ("z1", "up")], "entry_id string, vote string").coalesce(1).write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([("z3", "a bus", 1)], "entry_id string, description string, ts int").coalesce(1).write.parquet(str(tmp_path / "d"))
    frames(spark, [(0, "z2", "new", 9.0)]).drop("seq").withColumn("change_order", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "u"))
    for name, apply in (("v", jobs.votes_into(path)), ("d", jobs.descriptions_into(path)), ("u", jobs.changes_into(path))):
        for again in range(2):  # a second stream over the same rows replays batch 0
            stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
            jobs.for_each_batch(stream, apply, str(tmp_path / f"c-{name}{again}"), "append").awaitTermination()
    rows = {r["id"]: r for r in table.read_index(spark, path).collect()}
    assert len(rows) == 36 and rows["a0"]["feedback_downvotes"] == 2 and rows["z3"]["description"] == "a bus" and rows["z2"]["camera"] == "new" and rows["z2"]["seq"] == 2


def test_ids_count_once_within_a_delay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "t")
    run = lambda: jobs.ingest(spark, str(tmp_path / "in"), path, str(tmp_path / "c"), dedupe="1 hour").awaitTermination()
    lines(tmp_path / "in", "1.json", [{"id": "a", "wall_time": 0.0}, {"id": "a", "wall_time": 100.0}, {"id": "b", "wall_time": 0.0}, {"id": "a", "wall_time": 8000.0}, {"id": "n"}, {"id": "n"}], 1000)
    run()
    lines(tmp_path / "in", "2.json", [{"id": "b", "wall_time": 3000.0}, {"id": "b", "wall_time": 9000.0}, {"id": "c", "wall_time": 1.0}], 2000)
    run()
    assert facts(spark, path, "id", "wall_time") == [("a", 0.0), ("a", 8000.0), ("b", 0.0), ("b", 9000.0), ("c", 1.0), ("n", None), ("n", None)]


def test_retention_of_a_stream_keeps_rows_once(spark, tmp_path):
    spark.createDataFrame([("x", 0.0), ("x", DAY * 3), ("y", 0.0)], "class string, age_ts double").coalesce(1).write.parquet(str(tmp_path / "r"))
    keep = jobs.retain_batch(spark.createDataFrame([("x", 2)], "class string, days int"), str(tmp_path / "kept"))
    for again in range(2):
        rows = spark.readStream.schema("class string, age_ts double").parquet(str(tmp_path / "r"))
        jobs.for_each_batch(rows, keep, str(tmp_path / f"c{again}"), "append").awaitTermination()
    assert sorted((r["class"], r["age_ts"]) for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [("x", DAY * 3), ("y", 0.0)]
    assert files.list_files(spark, str(tmp_path / "kept")).count() > 0
