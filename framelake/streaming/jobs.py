"""Structured Streaming jobs that keep the index current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelake.operators.embedding import Encoder
from framelake.operators.frames import apply_retention
from framelake.operators.statistics import all_counts
from framelake.operators.times import recorded, session_windows
from framelake.schemas import FRAMES
from framelake.sources.files import in_order, lines_of, parsed, with_defaults
from framelake.sources.table import append_frames, read_index, store_changes, store_descriptions, store_votes


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True, dedupe: str | None = None, stream: str = "ingest") -> StreamingQuery:
    """New files of JSON frames, appended to the index at `target`, batch by batch: read_index reads them with seq in their order of arrival.

    A batch that runs again takes its own place. dedupe: a delay like "1 hour"; a frame goes whose id the frame before it of that id, in the batch
    or the index, has within the delay (wall_time null: never). Streams into one index need names of their own.
    """
    json = parsed(FRAMES)

    def write(lines: DataFrame, batch: int) -> None:
        rows = in_order(lines, {"_json": json}).where(F.col("_json").isNotNull() & F.col("_json._corrupt").isNull())
        rows, own = with_defaults(rows.select("_json.*", "seq").drop("_corrupt")), f"{stream}-{batch}"
        append_frames(first_of_ids(rows, read_index(spark, target).where(F.col("batch") != own), dedupe) if dedupe else rows, target, own)

    return for_each_batch(lines_of(spark.readStream, source), write, checkpoint, "append", once)


def first_of_ids(rows: DataFrame, index: DataFrame, delay: str) -> DataFrame:
    """rows without those whose id stands shortly before in wall_time, in rows (by seq) or in an index; only days within reach are looked at."""
    seconds = F.expr(f"unix_micros(timestamp_seconds(0) + interval {delay}) / 1e6")
    ends = rows.agg(F.min("wall_time") - seconds, F.max("wall_time") + seconds).first()
    if ends[0] is None:
        return rows
    before = F.lag("wall_time").over(Window.partitionBy("id").orderBy("seq"))
    kept = rows.withColumn("_before", before).where(~F.coalesce(F.abs(F.col("wall_time") - F.col("_before")) <= seconds, F.lit(False))).drop("_before")
    days = [F.to_date(F.timestamp_seconds(F.lit(t))) for t in ends]
    near = index.where(F.col("day").between(*days)).select(F.col("id").alias("_id"), F.col("wall_time").alias("_time"))
    return kept.join(near, (F.col("id") == F.col("_id")) & (F.abs(F.col("wall_time") - F.col("_time")) <= seconds), "left_anti")


def live_sessions(scores: DataFrame, threshold: float = 0.02, buffer: float = 2.0, late: str = "10 seconds") -> DataFrame:
    """motion_sessions over a stream(camera, ts timestamp, score): a session is given out when the watermark passes its end."""
    return recorded(session_windows(scores.withWatermark("ts", late), threshold, buffer), buffer, None)


def down_votes(votes: DataFrame) -> DataFrame:
    """Running down-votes of each entry of a stream of votes."""
    return votes.where(F.col("vote") == "down").groupBy("entry_id").agg(F.count("*").alias("downs"))


def running_counts(frames: DataFrame) -> DataFrame:
    """Running (kind, key, n) of labels (from counts, where a frame has them), colours and tags in a stream of frames."""
    return all_counts(frames)


def running_bounds(frames: DataFrame) -> DataFrame:
    """Running number of frames and objects, and bounds of their wall times, in a stream of frames: one row."""
    objects = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda n, x: n + x)
    return frames.groupBy().agg(F.count("*").alias("total_frames"), F.coalesce(F.sum(objects), F.lit(0)).alias("total_objects"), F.min("wall_time").alias("time_min"), F.max("wall_time").alias("time_max"))


def for_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Hands every micro-batch to `apply`, which may join it to tables (votes, descriptions, upserts)."""
    out = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode)
    return (out.trigger(availableNow=True) if once else out).start()


def retain_batch(policy: DataFrame, target: str, time_col: str = "age_ts", class_col: str = "class", stream: str = "retain") -> Callable[[DataFrame, int], None]:
    """For for_each_batch: keeps what retention keeps, `now` being the batch's latest time, in a folder of the batch that a second run fills anew."""

    def apply(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(time_col)).first()[0]
        if now is not None:
            apply_retention(batch, policy, now, time_col, class_col).write.mode("overwrite").parquet(f"{target}/stream={stream}/batch={number}")

    return apply


def votes_into(path: str, stream: str = "votes") -> Callable[[DataFrame, int], None]:
    """For for_each_batch over votes(entry_id, vote): down-votes end in the index, once each."""
    return lambda batch, number: store_votes(batch.sparkSession, path, batch, stream, number)


def descriptions_into(path: str, encoder: Encoder | None = None) -> Callable[[DataFrame, int], None]:
    """For for_each_batch over descriptions(entry_id, description, ts)."""
    return lambda batch, _: store_descriptions(batch.sparkSession, path, batch, encoder)


def changes_into(path: str, stream: str = "changes", order_col: str = "change_order") -> Callable[[DataFrame, int], None]:
    """For for_each_batch over changed frames: upserts end in the index."""
    return lambda batch, number: store_changes(batch.sparkSession, path, batch, f"{stream}-{number}", order_col)
