"""Filters, projections and pages over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.columns import clip_clock, cut_clock, wall_clock
from framelake.functions.vocabulary import SUPPORTED_LABELS, UNAVAILABLE


def filter_wall_time(frames: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Frames whose wall_time lies in [start, end]; with any bound, frames without one go."""
    if start is not None:
        frames = frames.where(F.col("wall_time") >= start)
    return frames.where(F.col("wall_time") <= end) if end is not None else frames


def query_by_time(frames: DataFrame, start: float, end: float, top_k: int = 10) -> DataFrame:
    """The first `top_k` frames, in order of arrival, whose offset into the clip lies in [start, end]; score 1."""
    return frames.where(F.col("timestamp").between(start, end)).withColumn("score", F.lit(1.0)).orderBy("seq").limit(top_k)


def get_frame(frames: DataFrame, frame_id: str) -> DataFrame:
    """The first frame with this id."""
    return frames.where(F.col("id") == frame_id).orderBy("seq").limit(1)


#: Rows that one task may sort and skip, and ranges of seq that are counted at once on the way to fewer.
FEW, RANGES = 10_000, 4096


def seq_range(frames: DataFrame, place: int) -> tuple[int, int, int]:
    """(low, high, before): the row at `place` (from 0) in order of seq is among those of low <= seq < high, FEW at most or of one seq; `before` rows are under low.

    Ranges of seq are counted, a row for each, and the range that holds the place is counted in finer ones, until it holds few
    rows. Beyond the last row the range is empty.
    """
    ends = frames.agg(F.min("seq"), F.max("seq"), F.count("seq")).first()
    if place >= ends[2]:
        return (top := 0 if ends[1] is None else ends[1] + 1), top, ends[2]
    low, high, before, held = ends[0], ends[1] + 1, 0, ends[2]
    while held > FEW and high - low > 1:
        width = -(-(high - low) // RANGES)
        own = frames.where((F.col("seq") >= low) & (F.col("seq") < high))
        counts = own.groupBy(F.expr(f"(seq - {low}) div {width}").alias("range")).agg(F.count("*").alias("n"))
        for r in sorted(counts.collect()):  # RANGES rows at most
            if before + r["n"] > place:
                low, held = low + r["range"] * width, r["n"]
                high = min(high, low + width)
                break
            before += r["n"]
    return low, high, before


def recent(frames: DataFrame, n: int | None) -> DataFrame:
    """The last n frames by seq, in no order (None: all): what a search with `recent_n` looks at. Of many, only few are sorted."""
    if n is None:
        return frames
    if n <= FEW:
        return frames.orderBy(F.desc("seq")).limit(n)
    first = max(0, frames.count() - n)
    low, high, before = seq_range(frames, first)
    edge = frames.where((F.col("seq") >= low) & (F.col("seq") < high)).orderBy("seq").offset(first - before)
    return frames.where(F.col("seq") >= high).unionByName(edge)


def tail_rows(frames: DataFrame, n: int) -> DataFrame:
    """The last n rows in order of arrival; 0 means all."""
    return (frames if n == 0 else recent(frames, n)).orderBy("seq")


def page(frames: DataFrame, limit: int = 50, offset: int = 0, compat: bool = False) -> DataFrame:
    """Rows offset .. offset + limit by seq. compat: of the last limit + offset rows, as older callers expect.

    A deep page is found by counts of ranges of seq; only rows of the ranges that it lies in are read and sorted.
    """
    if compat:
        offset += max(0, frames.count() - limit - offset)
    if offset + limit <= FEW:
        return frames.orderBy("seq").offset(offset).limit(limit)
    low, _, before = seq_range(frames, offset)
    _, high, _ = seq_range(frames, offset + limit - 1) if limit else (0, low, 0)
    return frames.where((F.col("seq") >= low) & (F.col("seq") < high)).orderBy("seq").offset(offset - before).limit(limit)


def project_results(frames: DataFrame) -> DataFrame:
    """All columns, with sorted distinct colours, the score to 4 places, and both times as text."""
    colors = F.array_sort(F.array_distinct(F.filter(F.transform("objects", lambda o: o["color_name"]), lambda c: F.coalesce(c, F.lit("")) != "")))
    out = frames.withColumn("colors", colors).withColumn("timestamp_str", clip_clock(F.col("timestamp"))).withColumn("wall_time_str", wall_clock(F.col("wall_time")))
    return out.withColumn("score", F.round("score", 4)) if "score" in frames.columns else out


def cut_list(results: DataFrame, duration: float = 5.0) -> DataFrame:
    """Where to cut each result's clip: start, its clock text, length and output name."""
    start = F.greatest(F.lit(0.0), F.col("timestamp") - duration / 2)
    return results.select("id", "source_clip", start.alias("start"), cut_clock(start).alias("start_clock"), F.lit(duration).alias("duration"), F.concat("id", F.lit(".mp4")).alias("output"))


def apply_retention(rows: DataFrame, policy: DataFrame, now: float, age_col: str = "age_ts", class_col: str = "class") -> DataFrame:
    """Rows of age_ts not older than now - days * 86400 of their class; classes without a policy stay.

    policy(class, days) has a row for each class of recordings, a handful.
    """
    limits = policy.select(F.col("class").alias("_class"), (F.lit(now) - F.col("days") * 86400.0).alias("_cutoff"))
    kept = rows.join(limits, F.col(class_col) == F.col("_class"), "left").where(F.col("_cutoff").isNull() | (F.col(age_col) >= F.col("_cutoff")))
    return kept.drop("_class", "_cutoff")


def expired(rows: DataFrame, policy: DataFrame, now: float, age_col: str = "age_ts", class_col: str = "class") -> DataFrame:
    """The rows that apply_retention drops."""
    limits = policy.select(F.col("class").alias("_class"), (F.lit(now) - F.col("days") * 86400.0).alias("_cutoff"))
    return rows.join(limits, F.col(class_col) == F.col("_class")).where(F.col(age_col) < F.col("_cutoff")).drop("_class", "_cutoff")


def any_label(labels: Column, wanted: list[str]) -> Column:
    """Whether any of the wanted labels is present."""
    return F.arrays_overlap(labels, F.array(*[F.lit(w) for w in wanted]))


def check_labels(tracked: list[str]) -> list[str]:
    """The tracked labels, if all are supported."""
    if unknown := sorted(set(tracked) - set(SUPPORTED_LABELS)):
        raise ValueError(f"labels not supported: {', '.join(unknown)}")
    return tracked


def unsupported_labels(frames: DataFrame) -> DataFrame:
    """(id, unsupported) of frames with labels outside the supported ones."""
    return frames.select("id", F.array_except("labels", F.array(*[F.lit(x) for x in SUPPORTED_LABELS])).alias("unsupported")).where(F.size("unsupported") > 0)


def storable_descriptions(descriptions: DataFrame) -> DataFrame:
    """Descriptions that may be stored: those that don't say they are unavailable."""
    return descriptions.where(~F.col("description").startswith(UNAVAILABLE))


def cap_keyframes(keyframes: DataFrame, most: int = 100) -> DataFrame:
    """The first `most` keyframes of each clip(clip, ts_order, ts), numbered f0000, f0001, ..."""
    number = F.row_number().over(Window.partitionBy("clip").orderBy("ts_order")) - 1
    return keyframes.withColumn("_n", number).where(F.col("_n") < most).withColumn("frame_name", F.format_string("f%04d", "_n")).drop("_n")


def sampling_plan(clips: DataFrame, hits: DataFrame, stop: int = 55, step: int = 5) -> DataFrame:
    """(clip, ts) every `step` seconds for clips that no scene hit names."""
    return clips.select("clip").distinct().join(hits.select("clip"), "clip", "left_anti").select("clip", F.explode(F.sequence(F.lit(0), F.lit(stop), F.lit(step))).alias("ts"))


def channel_label(camera: Column) -> Column:
    """A camera's name, "default" when empty."""
    return F.coalesce(F.nullif(camera, F.lit("")), F.lit("default"))


def split_labels(text: Column) -> Column:
    """A comma-separated list without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def wall_times(frames: DataFrame) -> DataFrame:
    """wall_time = the clip's time (given, else derived) plus the offset; null stays null."""
    return frames.withColumn("wall_time", F.coalesce("given_wall_time", "derived_wall_time") + F.col("timestamp"))


def with_sequence(frames: DataFrame, start: int = 0) -> DataFrame:
    """seq in the order of partitions and rows as read: increasing, not dense."""
    return frames.withColumn("seq", F.monotonically_increasing_id() + F.lit(start))
