"""Building the index: clips and their keyframes with detections become embedded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.columns import clip_stem, derive_wall_time
from framelake.operators.detections import assemble_frames, keep_detections, sized
from framelake.operators.embedding import Encoder, embed_frames, hash_embedding
from framelake.operators.frames import cap_keyframes, channel_label, sampling_plan, wall_times


def plan_keyframes(clips: DataFrame, hits: DataFrame, most: int = 100) -> DataFrame:
    """(clip, ts, frame_name): the first `most` scene hits(clip, ts) of each clip, or every five seconds where there is none."""
    found = cap_keyframes(hits.select("clip", F.col("ts").cast("double").alias("ts"), F.col("ts").alias("ts_order")), most).drop("ts_order")
    step = 5
    plan = sampling_plan(clips.select(F.col("path").alias("clip")), hits, step=step)
    plan = plan.select("clip", F.col("ts").cast("double").alias("ts"), F.format_string("f%04d", (F.col("ts") / step).cast("int")).alias("frame_name"))
    return found.select("clip", "ts", "frame_name").unionByName(plan)


def build_index(clips: DataFrame, hits: DataFrame, detections: DataFrame, encoder: Encoder = hash_embedding, labels: list[str] | None = None, threshold: float = 0.5, batch: int = 32) -> DataFrame:
    """Frames, ready to be appended to an index, of clips(path, modified, camera, wall_time).

    Keyframes are a clip's scene hits(clip, ts), else the sampling plan. A frame's id is the clip's stem and eight
    hex digits of a hash of clip and frame name, so building twice gives equal ids. wall_time is the clip's, or what its name or
    modification time says, plus the offset; an empty camera is "default". detections(clip, frame_name, det_idx, label, confidence,
    bbox, frame_area, color_hex, color_name) are kept by label, confidence and size and gathered by frame;
    tags, or the id without any, are embedded. Frames without detections stay. No seq is given: see append.
    """
    known = clips.select(
        F.col("path").alias("clip"), channel_label(F.col("camera")).alias("camera"), F.col("wall_time").cast("double").alias("given_wall_time"),
        derive_wall_time(F.col("path"), F.col("modified").cast("double")).alias("derived_wall_time"),
    )
    name = F.concat(clip_stem(F.col("clip")), F.lit("_"), F.substring(F.md5(F.concat_ws("|", "clip", "frame_name")), 1, 8))
    frames = wall_times(plan_keyframes(clips, hits).join(known, "clip").withColumnRenamed("ts", "timestamp"))
    frames = frames.select(
        name.alias("id"), "timestamp", F.col("clip").alias("source_clip"), F.concat("clip", F.lit("/"), "frame_name", F.lit(".jpg")).alias("thumbnail_path"), "wall_time", "camera", F.lit(0.0).alias("motion_score"),
        F.create_map(F.lit("camera"), "camera", F.lit("clip_name"), F.regexp_extract("clip", "([^/]*)$", 1)).alias("metadata"),
    )
    seen = detections.withColumn("frame_id", name).drop("clip", "frame_name")
    whole = assemble_frames(sized(keep_detections(seen, labels, threshold)), frames)
    return embed_frames(whole, encoder, batch)
