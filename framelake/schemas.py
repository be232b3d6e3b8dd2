"""Schemas of the tables that jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _DOUBLE, _FLOATS, _STRINGS = T.StringType(), T.DoubleType(), T.ArrayType(T.FloatType()), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


OBJECT = _struct(label=_STRING, confidence=_DOUBLE, bbox=T.ArrayType(_DOUBLE), area=_DOUBLE, color_hex=_STRING, color_name=_STRING, size=_STRING)

#: One indexed frame. `seq` is the order of arrival; every ordering ends in it.
FRAMES = _struct(
    id=_STRING, timestamp=_DOUBLE, source_clip=_STRING, thumbnail_path=_STRING, wall_time=_DOUBLE, camera=_STRING, motion_score=_DOUBLE,
    labels=_STRINGS, objects=T.ArrayType(OBJECT), counts=T.MapType(_STRING, T.LongType()), embedding=_FLOATS, text_embedding=_FLOATS,
    metadata=T.MapType(_STRING, _STRING), tags=_STRINGS, detection_confidence=_DOUBLE,
)

REQUIRED = ("id", "timestamp", "source_clip", "thumbnail_path")

#: What a missing optional field stands for.
DEFAULTS = {
    "camera": "'default'", "motion_score": "0.0D", "labels": "array()", "objects": "array()", "counts": "map()",
    "embedding": "array()", "text_embedding": "array()", "metadata": "map()", "tags": "array()", "detection_confidence": "0.0D",
}

#: Either layout of a vector record.
VECTOR_RECORD = _struct(
    id=_STRING, vector=_FLOATS, embedding=_FLOATS, text_embedding=_FLOATS, metadata=T.MapType(_STRING, _STRING), camera=_STRING,
)

EVENTS = _struct(camera=_STRING, label=_STRING, timestamp=_STRING)
