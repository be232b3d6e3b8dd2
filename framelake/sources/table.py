"""The index as a Parquet table in folders camera=/day=/batch=, with changes that last and may be repeated.

Each write belongs to a batch and gives the same table when it runs again, so a stream may replay its last batch.
Appends fill a folder of their own. Changes rewrite only the folders that hold a changed row: their new content is staged whole,
then takes their place folder by folder; a swap that was cut short is rolled back or completed by the next change. One writer at a time; a reader
during a swap may miss a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.frames import channel_label, storable_descriptions
from framelake.operators.maintenance import apply_descriptions, last_changes, numbered
from framelake.schemas import FRAMES
from framelake.sources.files import defaulted

PARTS = ["camera", "day", "batch"]
#: What frames of the index hold beside FRAMES; `applied` is the last batch of each stream of votes that a row has counted.
INDEX = T.StructType(
    [
        *FRAMES.fields, T.StructField("seq", T.LongType()), T.StructField("description", T.StringType()), T.StructField("feedback_downvotes", T.IntegerType()),
        T.StructField("applied", T.MapType(T.StringType(), T.LongType())), T.StructField("day", T.DateType()), T.StructField("batch", T.StringType()),
    ]
)
_STAGED, _OLD = "_staged", "_replaced"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, place = _place(spark, target)
    files.mkdirs(place.getParent())
    if not files.rename(_place(spark, source)[1], place):
        raise OSError(f"can't move {source} to {target}")


def read_index(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """The table (or some of its folders) with all columns of INDEX; null ones where it has none. A table that isn't there is empty."""
    if not exists(spark, path) or folders == []:
        return spark.createDataFrame([], INDEX)
    places = [path] if folders is None else [f"{path}/{f}" for f in folders]
    return spark.read.schema(INDEX).option("basePath", path).parquet(*places)


def _fitted(frames: DataFrame) -> DataFrame:
    """frames with the columns of INDEX but batch."""
    day = F.to_date(F.timestamp_seconds("wall_time")) if "wall_time" in frames.columns else F.lit(None)
    frames = frames.withColumn("day", day)
    rows = frames.select(*[(F.col(f.name) if f.name in frames.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in INDEX.fields if f.name != "batch"])
    return defaulted(rows).withColumn("camera", channel_label(F.col("camera")))


def _write(rows: DataFrame, path: str) -> None:
    """Only the folders that rows fall into are overwritten; a folder's rows are gathered, and large folders split, before."""
    rows.hint("rebalance", *PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def append_frames(frames: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends frames as a batch; null wall_time: day null. seq goes on after the largest of the other batches.

    Frames without seq are numbered by source_clip and timestamp. A batch that is written again takes its own place; without a
    name it is a new one.
    """
    spark = frames.sparkSession
    restored(spark, path)
    table = read_index(spark, path)
    batch = batch if batch is not None else uuid.uuid4().hex
    top = table.where(F.col("batch") != batch).agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
    if "seq" not in frames.columns:
        frames = numbered(frames, "source_clip", "timestamp").withColumnRenamed("_place", "seq")
    for folder in folders_of(in_folders(table).where(F.col("batch") == batch)):
        _delete(spark, f"{path}/{folder}")
    _write(_fitted(frames).withColumns({"seq": F.col("seq") + F.lit(top), "batch": F.lit(batch)}), path)


def in_folders(rows: DataFrame) -> DataFrame:
    """Rows that are read from the table with `_folder`, their folder below it."""
    name = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+/[^/]+)/[^/]+$", 1)
    return rows.withColumn("_folder", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))


def folders_of(rows: DataFrame) -> list[str]:
    """The folders of rows: a name for each on the driver, where Spark lists them anyway."""
    return sorted(r[0] for r in rows.select("_folder").distinct().collect())


def restored(spark: SparkSession, path: str) -> None:
    """Ends a swap that was cut short: folders that lack their new content get the old one back. A table that isn't there is made, without rows."""
    files, place = _place(spark, path)
    files.mkdirs(place)
    if exists(spark, f"{path}/{_OLD}"):
        files, place = _place(spark, f"{path}/{_OLD}")
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, "*/*/*")) or []
        for folder in ["/".join(f.getPath().toString().split("/")[-3:]) for f in found]:
            if not exists(spark, f"{path}/{folder}"):
                _move(spark, f"{path}/{_OLD}/{folder}", f"{path}/{folder}")
        _delete(spark, f"{path}/{_OLD}")
    _delete(spark, f"{path}/{_STAGED}")


def rewrite(spark: SparkSession, path: str, folders: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Puts change(rows) in the place of the rows of some folders, which must stay in their folders; folders left empty go."""
    if not folders:
        return
    _delete(spark, f"{path}/{_STAGED}")
    _write(change(read_index(spark, path, folders)), f"{path}/{_STAGED}")
    for folder in folders:
        _move(spark, f"{path}/{folder}", f"{path}/{_OLD}/{folder}")
        if exists(spark, f"{path}/{_STAGED}/{folder}"):
            _move(spark, f"{path}/{_STAGED}/{folder}", f"{path}/{folder}")
    for leftover in (_OLD, _STAGED):
        _delete(spark, f"{path}/{leftover}")


def store_votes(spark: SparkSession, path: str, votes: DataFrame, stream: str, batch: int) -> None:
    """Adds the down-votes(entry_id, vote) of a batch to the rows of their ids; rows that have counted this batch, or a later one of the stream, stay."""
    restored(spark, path)
    downs = votes.where(F.col("vote") == "down").groupBy(F.col("entry_id").alias("id")).agg(F.count("*").cast("int").alias("_downs"))
    done = F.coalesce(F.try_element_at("applied", F.lit(stream)), F.lit(-1)) >= batch
    folders = folders_of(in_folders(read_index(spark, path)).where(~done).join(downs, "id", "left_semi"))
    mark = F.create_map(F.lit(stream), F.lit(batch).cast("long"))
    kept = F.map_filter(F.coalesce("applied", F.create_map().cast("map<string,bigint>")), lambda k, _: k != stream)

    def counted(rows: DataFrame) -> DataFrame:
        new = F.col("_downs").isNotNull() & ~done
        out = rows.join(downs, "id", "left")
        out = out.withColumn("feedback_downvotes", F.when(new, F.coalesce("feedback_downvotes", F.lit(0)) + F.col("_downs")).otherwise(F.col("feedback_downvotes")))
        return out.withColumn("applied", F.when(new, F.map_concat(kept, mark)).otherwise(F.col("applied"))).drop("_downs").select(*rows.columns)

    rewrite(spark, path, folders, counted)


def store_descriptions(spark: SparkSession, path: str, descriptions: DataFrame, encoder=None) -> None:
    """Sets the last description(entry_id, description, ts) of each id, and with an encoder the text vector; ones that mustn't be stored are left out."""
    restored(spark, path)
    good = storable_descriptions(descriptions)
    folders = folders_of(in_folders(read_index(spark, path)).join(good.select(F.col("entry_id").alias("id")), "id", "left_semi"))
    rewrite(spark, path, folders, lambda rows: apply_descriptions(rows, good, encoder).select(*rows.columns))


def store_changes(spark: SparkSession, path: str, changes: DataFrame, batch: str, order_col: str = "change_order") -> None:
    """Upserts: the last change of each id takes the seq of the id's first row, new ids come after all rows.

    Changed rows go to the batch's own folders first, then leave their old ones; in between a reader sees both. When it runs again, rows of
    the batch are found by their ids and keep their seq.
    """
    restored(spark, path)
    table = read_index(spark, path)
    last = last_changes(changes, order_col).drop("seq")
    first = table.groupBy("id").agg(F.min("seq").alias("seq"))
    top = table.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_top"))
    known = last.join(first, "id")
    fresh = numbered(last.join(first, "id", "left_anti"), order_col, "id").crossJoin(F.broadcast(top)).withColumn("seq", F.col("_top") + 1 + F.col("_place")).drop("_top", "_place")
    rows = _fitted(known.select(*fresh.columns).unionByName(fresh)).withColumn("batch", F.lit(batch))
    _write(rows, path)
    moved = read_index(spark, path).where(F.col("batch") == batch).select("id", "seq")
    rest = in_folders(read_index(spark, path)).where(F.col("batch") != batch)
    folders = folders_of(rest.join(moved, ["id", "seq"], "left_semi"))
    rewrite(spark, path, folders, lambda old: old.join(moved, ["id", "seq"], "left_anti").select(*old.columns))


def store_retention(spark: SparkSession, path: str, now: float, days: float) -> None:
    """Drops rows whose wall_time is before now - days * 86400: whole folders of earlier days unread, then the rows of the day of the limit."""
    restored(spark, path)
    cutoff = now - days * 86400.0
    day = F.to_date(F.timestamp_seconds(F.lit(cutoff)))
    table = read_index(spark, path)
    for folder in folders_of(in_folders(table).where(F.col("day") < day)):
        _delete(spark, f"{path}/{folder}")
    late = folders_of(in_folders(read_index(spark, path)).where((F.col("day") == day) & (F.col("wall_time") < cutoff)))
    rewrite(spark, path, late, lambda rows: rows.where(F.col("wall_time") >= cutoff))
