"""From detected boxes to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.columns import box_area, build_tags, size_class
from framelake.functions.vocabulary import SUPPORTED_LABELS
from framelake.operators.frames import check_labels


def keep_detections(detections: DataFrame, labels: list[str] | None = None, threshold: float = 0.5, min_area_ratio: float = 0.005) -> DataFrame:
    """Detections of tracked labels, sure enough, and large enough where the frame's area is known."""
    tracked = check_labels(list(labels or SUPPORTED_LABELS))
    area = F.coalesce(F.col("frame_area"), F.lit(0.0))
    large = (area == 0) | (box_area(F.col("bbox")) / F.nullif(area, F.lit(0.0)) >= min_area_ratio)
    return filter_by_label(detections, tracked, threshold).where(large)


def filter_by_label(detections: DataFrame, labels: list[str], threshold: float = 0.5) -> DataFrame:
    """Detections of the labels with at least this confidence."""
    return detections.where(F.col("label").isin(labels) & (F.col("confidence") >= threshold))


def sized(detections: DataFrame) -> DataFrame:
    """With the size class; null without a frame area."""
    return detections.withColumn("size", F.when(F.col("frame_area") > 0, size_class(F.col("bbox"), F.col("frame_area"))))


#: What a frame's objects hold.
FIELDS = ("label", "confidence", "bbox", "area", "color_hex", "color_name", "size")


def assemble_frames(detections: DataFrame, frames: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """frames(id, ...) with labels, objects, counts, detection_confidence and tags of their detections.

    One shuffle on the frame. Objects keep detection order, confidence to 4 places, boxes to 2, areas to
    1. Frames without detections stay, with empty lists and confidence 0. A mean is cut to 9 places before
    it is rounded to 4, so that the order of summation doesn't decide ties. fields: what objects hold (label, color_name and size at least); what is left out isn't shuffled.
    """
    made = {"confidence": F.round("confidence", 4), "bbox": F.transform("bbox", lambda x: F.round(x, 2)), "area": F.round(box_area(F.col("bbox")), 1)}
    o = F.struct("det_idx", *[made.get(f, F.col(f)).alias(f) for f in fields])
    grouped = detections.groupBy("frame_id").agg(F.array_sort(F.collect_list(o)).alias("_o"), F.avg("confidence").alias("_mean"))
    objects = F.transform("_o", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    labels = F.transform("_o", lambda x: x["label"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(labels)), lambda k: F.struct(k, F.size(F.filter(labels, lambda x: x == k)).cast("long"))))
    rows = grouped.select(F.col("frame_id").alias("id"), labels.alias("labels"), objects.alias("objects"), counts.alias("counts"), F.round(F.round("_mean", 9), 4).alias("detection_confidence"))
    whole = frames.drop("labels", "objects", "counts", "detection_confidence", "tags").join(rows, "id", "left")
    whole = whole.withColumns({
        "labels": F.coalesce("labels", F.array().cast("array<string>")),
        "objects": F.coalesce("objects", F.array().cast(rows.schema["objects"].dataType)),
        "counts": F.coalesce("counts", F.create_map().cast("map<string,bigint>")),
        "detection_confidence": F.coalesce("detection_confidence", F.lit(0.0)),
    })
    return whole.withColumn("tags", build_tags(F.col("objects")))
