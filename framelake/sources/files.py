"""Readers and writers of frames, vectors, events, logs, images and file lists. For the index as a table see table.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from framelake.schemas import DEFAULTS, EVENTS, FRAMES, REQUIRED, VECTOR_RECORD


#: Where a line stands: its file, when that was written, and where the split that holds it begins.
PLACE = {"_file": "file_path", "_modified": "file_modification_time", "_block": "file_block_start"}
#: The part number and the write of a file that Spark wrote.
_PART = r"part-(\d+)-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$"


def lines_of(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Lines of text files as `value`, with their PLACE."""
    return reader.text(path).select("value", *[F.col(f"_metadata.{field}").alias(name) for name, field in PLACE.items()])


def in_order(lines: DataFrame, more: dict[str, Column] | None = None, order: str = "time") -> DataFrame:
    """lines(value, PLACE) with seq = 0, 1, ... in the order of arrival, and with more columns made from them, without PLACE.

    Files come in the order in which they were written (order "name": of their paths); those of one write of Spark by part number, equal
    times by path. In a file lines come as they stand. A first scan counts the lines of each split, and only these counts, a row for each
    split (as many as the scan has tasks), are summed up and sent to the second scan, where a line's number in its split is known.
    """
    write, part = (F.nullif(F.regexp_extract("_file", _PART, i), F.lit("")) for i in (2, 1))
    placed = lines.withColumns({"_at": F.monotonically_increasing_id(), **(more or {})})  # in one step, so that no filter on `more` comes before the ids
    splits = placed.groupBy("_file", "_block").agg(F.max("_modified").alias("_modified"), F.count("*").alias("_n"), F.min("_at").alias("_first"))
    splits = splits.withColumn("_write", F.coalesce(write, F.col("_file"))).withColumn("_time", F.max("_modified").over(Window.partitionBy("_write")))
    ways = {"time": ["_time", "_write", part.cast("long"), "_file", "_block"], "name": ["_file", "_block"]}
    before = F.sum("_n").over(Window.orderBy(*ways[order])) - F.col("_n")
    begins = splits.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(begins), ["_file", "_block"]).withColumn("seq", F.col("_at") + F.col("_shift")).drop(*PLACE, "_at", "_shift")


def parsed(schema: T.StructType, mode: str = "PERMISSIVE") -> Column:
    """A line as a struct of the schema; `_corrupt` isn't null where it doesn't fit."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return F.from_json("value", whole, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"})


def _json(spark: SparkSession, path: str, schema: T.StructType, order: str, mode: str = "PERMISSIVE") -> DataFrame:
    rows = in_order(lines_of(spark.read, path), {"_json": parsed(schema, mode)}, order)
    return rows.where((F.trim("value") != "") & F.col("_json").isNotNull() & F.col("_json._corrupt").isNull()).select("_json.*", "seq").drop("_corrupt")


def defaulted(rows: DataFrame) -> DataFrame:
    """Missing optional fields as their defaults."""
    kinds = {f.name: f.dataType.simpleString() for f in FRAMES.fields}
    return rows.withColumns({c: F.expr(f"coalesce({c}, cast({d} as {kinds[c]}))") for c, d in DEFAULTS.items()})


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing optional fields as their defaults; rows without a required field go."""
    return defaulted(rows.where(" and ".join(f"{c} is not null" for c in REQUIRED)))


def read_frames(spark: SparkSession, path: str, order: str = "time") -> DataFrame:
    """Frames of JSON-lines files, seq being their order (see in_order): blank and broken lines, and ones without a required field, are left out.

    Unknown fields are ignored. A field of another type makes its line broken (no text is taken for a number).
    """
    return with_defaults(_json(spark, path, FRAMES, order))


def read_vectors(spark: SparkSession, path: str, order: str = "time") -> DataFrame:
    """(seq, id, embedding, text_embedding, camera, label, metadata) of either layout of vector records.

    An empty vector counts as missing: then the other layout's field is taken. metadata holds all keys but the text vector, as text.
    """
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = _json(spark, path, VECTOR_RECORD, order).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("_text", F.from_json(F.try_element_at("metadata", F.lit("text_vector")), "array<float>"))
    entry = lambda key: F.try_element_at("metadata", F.lit(key))
    return rows.select(
        "seq", "id", F.coalesce(some("vector"), some("embedding")).alias("embedding"), F.coalesce(some("_text"), some("text_embedding")).alias("text_embedding"),
        F.coalesce("camera", entry("camera")).alias("camera"), entry("label").alias("label"), F.map_filter("metadata", lambda k, _: k != "text_vector").alias("metadata"),
    )


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Appends {id, vector, metadata} lines; metadata keeps its keys, camera, label, and the text vector when it isn't empty."""
    known = [F.when(F.col(c).isNotNull(), F.create_map(F.lit(c), F.col(c))) for c in ("camera", "label") if c in vectors.columns]
    known += [F.col("metadata")] if "metadata" in vectors.columns else []
    empty = F.create_map().cast("map<string,string>")
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(m, empty)) for m in known])) if known else F.map_entries(empty)
    named = F.aggregate(entries, empty, lambda out, e: F.when(F.map_contains_key(out, e["key"]), out).otherwise(F.map_concat(out, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))))
    own = F.regexp_replace(F.to_json(named), r"\}$", "")
    text = F.when(F.size("text_embedding") > 0, F.concat(F.when(F.size(named) > 0, ",").otherwise(""), F.lit('"text_vector":'), F.to_json("text_embedding")))
    line = F.concat(F.regexp_replace(F.to_json(F.struct("id", F.col("embedding").alias("vector"))), r"\}$", ""), F.lit(',"metadata":'), own, F.coalesce(text, F.lit("")), F.lit("}}"))
    vectors.select(line.alias("value")).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str, limit: int | None = 100, order: str = "time") -> DataFrame:
    """The last `limit` events of a log, in its order (None: all); one broken line fails the read, blank ones don't count."""
    rows = _json(spark, path, EVENTS, order, "FAILFAST")
    return rows if limit is None else rows.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def append_events(events: DataFrame, path: str) -> None:
    """Appends events; a missing timestamp is the present in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events.withColumn("timestamp", F.coalesce("timestamp", F.concat(now, F.lit("+00:00")))).write.mode("append").json(path)


def log_values(lines: DataFrame) -> DataFrame:
    """lines(clip, value) of a motion log with pts_time and scene_score: the last number on a line that is one."""
    number = lambda key: F.regexp_extract("value", f".*{key}" + r"\s*(\S+)", 1).try_cast("double")
    rows = lines.withColumns({"ts": number("pts_time:"), "score": number(r"lavfi\.scene_score=")})
    return rows.where("ts is not null or score is not null").drop("value")


def read_motion_log(spark: SparkSession, path: str) -> DataFrame:
    """(clip, seq, ts, score) of text logs; clip is the file, seq the order of lines."""
    return log_values(in_order(lines_of(spark.read, path), {"clip": F.col("_file")}).select("clip", "seq", "value"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(frame_path, image) with BGR bytes; an unreadable file has a null image. Filters on frame_path choose files before they are opened."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("frame_path"), F.when(F.col("image.height") > 0, F.col("image")).alias("image"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()
