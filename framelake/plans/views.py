"""Frames, detections, votes and so on, as views over the tables of orders, parts, events and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from framelake.functions.vocabulary import COLORS, SUPPORTED_LABELS
from framelake.operators.detections import assemble_frames, keep_detections, sized
from framelake.operators.embedding import embed_frames, hash_counts
from framelake.sources.shared import scratch

FRAME_AREA = 1280.0 * 720.0
#: Seconds that events are moved back by, into the years of the orders.
SHIFT = 26 * 31_557_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), key).alias("id"), key.alias("seq"), (key % 60).cast("double").alias("timestamp"), F.concat(F.lit("clip_"), cust % 200).alias("source_clip"),
        F.concat(F.lit("cam"), cust % 8).alias("camera"), F.when(F.col("o_orderstatus") != "P", F.round(epoch(F.col("o_orderdate"))) + key % 86400).alias("wall_time"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection for each line of an order."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(i) % len(names) + 1).cast("int"))
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))  # by the key that frames are assembled by: one shuffle
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("frame_id", F.concat(F.lit("f"), "l_orderkey")).select(
        "frame_id", number.alias("det_idx"), pick(SUPPORTED_LABELS, "l_partkey").alias("label"),
        (F.lit(0.4) + F.col("l_discount") * 5).alias("confidence"), F.array(F.lit(0.0), F.lit(0.0), q * 20, q * 10).alias("bbox"), F.lit(FRAME_AREA).alias("frame_area"),
        F.lit(None).cast("string").alias("color_hex"), pick(COLORS, "l_suppkey").alias("color_name"),
    )


def indexed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the labels, objects, counts and tags of the detections that are kept."""
    return assemble_frames(sized(keep_detections(detections(spark, sf_dir))), frames(spark, sf_dir))


def described_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed frames whose objects hold what searches look at."""
    return assemble_frames(sized(keep_detections(detections(spark, sf_dir))), frames(spark, sf_dir), ("label", "color_name", "size"))


def embedded(rows: DataFrame) -> DataFrame:
    """Frames with vectors of feature counts (whole numbers, so that sums are exact in any order), in files, as a search passes over them several times."""
    path = scratch(rows.sparkSession, "embedded")
    rows = embed_frames(rows, hash_counts, batch=4096, packed=True).drop("embedding", "counts", "tags")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).withColumn("embedding", F.col("text_embedding"))


def embedded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(described_frames(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each distinct part name, "red widget" and the like, with a label after some of them."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id")).distinct()
    label = F.element_at(F.array(*[F.lit(n) for n in SUPPORTED_LABELS]), (F.length("query_id") % 9 + 1).cast("int"))
    return names.select("query_id", F.when(F.length("query_id") % 2 == 0, F.concat_ws(" ", "query_id", label)).otherwise(F.col("query_id")).alias("text"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("cam"), F.col("user_id") % 8).alias("camera"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("score"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are up-votes, errors down-votes, purchases broken ones; some entries are unknown."""
    vote = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "error", "down").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), F.col("event_id") * 7 % 40_000).alias("entry_id"), vote.alias("vote"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("target_id"), (epoch(F.col("ts")) - SHIFT).alias("t"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("range_id"), (epoch(F.col("ts")) - SHIFT).alias("start"), (epoch(F.col("ts")) - SHIFT + F.col("value") * 100).alias("end"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("archive_id"), F.encode("text", "utf-8").alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's values as the pixels of a box."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    scaled = F.floor(F.abs(F.col("x").cast("double")) * 100_000).cast("long")
    v = F.when(F.col("vec_id") % 5 == 0, scaled % 50).otherwise(scaled % 256)
    s = F.when(F.col("vec_id") % 5 == 1, scaled % 30).otherwise((scaled + F.col("i") * 7) % 256)
    return rows.select(F.col("vec_id").alias("det_id"), ((scaled / 7).cast("long") % 180).alias("h"), s.alias("s"), v.alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's 64 values as an image of 8 by 8 BGR pixels."""
    x = lambda e: F.floor(F.abs(e.cast("double")) * 100_000).cast("long")
    byte = lambda v: F.lpad(F.hex(v % 256), 2, "0")
    pixel = lambda e, i: F.concat(byte(x(e)), byte(F.floor(x(e) / 3)), byte(F.floor(x(e) / 7) + i * 11))
    data = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("img"), "vec_id").alias("frame_path"), F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), data.alias("data")).alias("image"))


def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four boxes on each of those images: all of it, its middle columns, a box that is too narrow, and all of it from corner to corner the other way."""
    box = lambda *v: F.array(*[F.lit(float(n)) for n in v])
    boxes = F.array(box(0, 0, 8, 8), box(1.4, -3, 6.6, 8), box(0, 0, 3, 8), box(8, 8, 0, 0))
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("img"), "vec_id").alias("frame_path"), F.posexplode(boxes).alias("box", "bbox"))
