"""Order of arrival over several files, splits and writes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from framelake.operators import frames
from framelake.sources import files

FRAME = {"timestamp": 10.0, "source_clip": "c.mp4", "thumbnail_path": "t.jpg"}


def write(path, name, n, when, broken=()):
    text = "\n".join("" if i in broken else json.dumps({"id": f"{name}{i:06d}", **FRAME, "tags": ["x" * (i % 7)]}) for i in range(n)) + "\n"
    (path / f"{name}.jsonl").write_text(text)
    os.utime(path / f"{name}.jsonl", (when, when))
    return [f"{name}{i:06d}" for i in range(n) if i not in broken]


@pytest.fixture(params=["1k", "128m"])
def split(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_order_of_files_splits_and_lines(spark, tmp_path, split):
    """A small file after large ones, a large one first, blank and broken lines between."""
    want = [i for name, n, when in (("c", 50, 1000), ("a", 3, 2000), ("d", 900, 3000), ("b", 400, 4000)) for i in write(tmp_path, name, n, when, broken={7, 30})]
    with open(tmp_path / "c.jsonl", "a") as f:
        f.write('{"broken\n')
    os.utime(tmp_path / "c.jsonl", (1000, 1000))
    rows = files.read_frames(spark, str(tmp_path))
    got = [r["id"] for r in rows.select("id", "seq").orderBy("seq").collect()]
    assert got == want
    assert [r["id"] for r in frames.tail_rows(rows, 2).select("id").collect()] == want[-2:]
    assert frames.get_frame(rows.withColumn("id", F.substring("id", 2, 6)), "000001").first()["seq"] == 1  # the first file's
    by_name = files.read_frames(spark, str(tmp_path), order="name").orderBy("seq").select("id").collect()
    assert [r["id"] for r in by_name] == sorted(want)
    seqs = [r["seq"] for r in rows.select("seq").orderBy("seq").collect()]
    assert seqs[-1] == 50 + 1 + 3 + 900 + 400 - 1 and len(set(seqs)) == len(want)  # lines are counted, kept or not


def test_narrow_and_filtered_reads_keep_their_numbers(spark, tmp_path, split):
    write(tmp_path, "b", 300, 1000)
    write(tmp_path, "a", 40, 2000)
    rows = files.read_frames(spark, str(tmp_path))
    whole = {r["id"]: r["seq"] for r in rows.collect()}
    assert {r["id"]: r["seq"] for r in rows.where("id like 'a%' and camera = 'default'").select("id", "seq").collect()} == {k: v for k, v in whole.items() if k[0] == "a"}
    assert rows.where("camera = 'x'").count() == 0 and rows.count() == 340


def test_parts_of_one_write_go_by_number(spark, tmp_path, split):
    for i in range(3):
        df = spark.range(i * 500, i * 500 + 500, numPartitions=4).select(F.concat(F.lit("c"), "id").alias("camera"), F.lit("t").alias("timestamp"))
        files.append_events(df, str(tmp_path / "log"))
    parts = sorted((tmp_path / "log").glob("part-*"), reverse=True)
    for k, p in enumerate(parts):  # within a write, later parts may be finished first
        when = os.stat(p).st_mtime + k / 1000
        os.utime(p, (when, when))
    got = [int(r["camera"][1:]) for r in files.read_events(spark, str(tmp_path / "log"), None).orderBy("seq").collect()]
    assert sorted(got) == list(range(1500)) and got == [x for i in range(3) for x in range(i * 500, i * 500 + 500)]
    assert [r["camera"] for r in files.read_events(spark, str(tmp_path / "log"), 3).collect()] == ["c1497", "c1498", "c1499"]


def test_vectors_and_logs_are_numbered_too(spark, tmp_path, split):
    for name, when in (("z", 1000), ("y", 2000)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}", "vector": [1.0 * i]}) + "\n" for i in range(200)))
        (tmp_path / f"{name}.log").write_text("".join(f"pts_time: {i}\n" for i in range(200)))
        for kind in ("jsonl", "log"):
            os.utime(tmp_path / f"{name}.{kind}", (when, when))
    got = [r["id"] for r in files.read_vectors(spark, str(tmp_path / "*.jsonl")).orderBy("seq").collect()]
    assert got == [f"{n}{i}" for n in "zy" for i in range(200)]
    logs = files.read_motion_log(spark, str(tmp_path / "*.log")).orderBy("seq").collect()
    assert [(r["clip"][-5:], r["ts"]) for r in logs] == [(f"{n}.log", float(i)) for n in "zy" for i in range(200)]


def test_no_files(spark, tmp_path):
    assert files.read_frames(spark, str(tmp_path)).count() == 0
