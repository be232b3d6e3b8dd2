"""Counts and summaries of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.frames import channel_label


def index_stats(frames: DataFrame) -> DataFrame:
    """One row: frames, clips, objects, mean non-zero confidence, cameras (comma-joined), time bounds."""
    per_frame = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    mean = F.avg(F.when(F.col("detection_confidence") != 0, F.col("detection_confidence")))
    return frames.agg(
        F.count("*").alias("total_frames"), F.countDistinct("source_clip").alias("total_clips"), F.coalesce(F.sum(per_frame), F.lit(0)).alias("total_objects"),
        F.coalesce(F.round(F.round(mean, 9), 4), F.lit(0.0)).alias("avg_detection_confidence"),
        F.array_join(F.array_sort(F.collect_set(channel_label(F.col("camera")))), ",").alias("cameras"),
        F.min("wall_time").alias("time_min"), F.max("wall_time").alias("time_max"),
    )


def clip_counts(frames: DataFrame) -> DataFrame:
    """(clip, label, n): sums of counts; a frame without counts adds 1 for each distinct label. Clips without objects have a null label."""
    pairs = F.when(F.size("counts") > 0, F.map_entries("counts")).otherwise(F.transform(F.array_distinct("labels"), lambda x: F.struct(x.alias("key"), F.lit(1).cast("long").alias("value"))))
    rows = frames.select(F.col("source_clip").alias("clip"), F.explode_outer(pairs).alias("e")).groupBy("clip", F.col("e.key").alias("label")).agg(F.sum("e.value").alias("n"))
    some = rows.where("label is not null")
    none = frames.select(F.col("source_clip").alias("clip")).distinct().join(some, "clip", "left_anti").select("clip", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n"))
    return some.unionByName(none)


def label_counts(frames: DataFrame) -> DataFrame:
    """(label, n): sums of counts; a frame without counts adds 1 for each label, repeats included."""
    pairs = F.when(F.size("counts") > 0, F.map_entries("counts")).otherwise(F.transform("labels", lambda x: F.struct(x.alias("key"), F.lit(1).cast("long").alias("value"))))
    return frames.select(F.explode(pairs).alias("e")).groupBy(F.col("e.key").alias("label")).agg(F.sum("e.value").alias("n"))


def color_counts(frames: DataFrame) -> DataFrame:
    """(color, n) of all objects with a colour name, "unknown" included."""
    colors = frames.select(F.explode(F.transform("objects", lambda o: o["color_name"])).alias("color"))
    return colors.where(F.coalesce("color", F.lit("")) != "").groupBy("color").agg(F.count("*").alias("n"))


def tag_counts(frames: DataFrame) -> DataFrame:
    """(tag, n): frames that carry each tag."""
    return frames.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def all_counts(frames: DataFrame) -> DataFrame:
    """(kind, key, n) of labels, colours and tags from one scan and one shuffle."""
    pairs = F.when(F.size("counts") > 0, F.map_entries("counts")).otherwise(F.transform("labels", lambda x: F.struct(x.alias("key"), F.lit(1).cast("long").alias("value"))))
    entry = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.cast("long").alias("n"))
    rows = F.concat(
        F.transform(pairs, lambda e: entry("label", e["key"], e["value"])),
        F.transform(F.filter("objects", lambda o: F.coalesce(o["color_name"], F.lit("")) != ""), lambda o: entry("color", o["color_name"], F.lit(1))),
        F.transform("tags", lambda t: entry("tag", t, F.lit(1))),
    )
    return frames.select(F.explode(rows).alias("e")).groupBy("e.kind", "e.key").agg(F.sum("e.n").alias("n"))
