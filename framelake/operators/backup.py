"""Archives in numbered chunks, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 2953
PER_PAGE = 16


def _encoded(data_col: str):
    return F.translate(F.base64(F.col(data_col).cast("binary")), "\r\n", "")


def chunk_split(archives: DataFrame, data_col: str = "data", chunk: int = CHUNK) -> DataFrame:
    """(archive_id, idx, total, payload, page, row, col): base64 in slices, "i/total|slice", 16 to a page of 4 by 4."""
    rows = archives.select("archive_id", _encoded(data_col).alias("_b"))
    total = F.ceil(F.length("_b") / chunk).cast("long")
    rows = rows.where(F.length("_b") > 0).withColumn("total", total)
    slices = F.transform(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda i: F.substring(F.col("_b"), (i * chunk + 1).cast("int"), F.lit(chunk)))
    out = rows.select("archive_id", "total", F.posexplode(slices).alias("idx", "_s"))
    at = F.col("idx").cast("long")
    spot = F.pmod(at, F.lit(PER_PAGE))
    return out.select(
        "archive_id", at.alias("idx"), "total", F.concat(at, F.lit("/"), "total", F.lit("|"), "_s").alias("payload"),
        F.floor(at / PER_PAGE).alias("page"), F.floor(spot / 4).alias("row"), F.pmod(spot, F.lit(4)).alias("col"),
    )


def chunk_parse(chunks: DataFrame, data_col: str = "payload") -> DataFrame:
    """chunks with idx, total and slice of well-formed rows; others are left out."""
    head = F.regexp_extract(F.col(data_col), r"(?s)^([^|]*)\|", 1)
    part = lambda i: F.regexp_extract(head, r"^\s*(-?\d+)\s*/\s*(-?\d+)\s*$", i).try_cast("long")
    out = chunks.where(F.col(data_col).contains("|") & F.col(data_col).contains("/"))
    out = out.withColumn("idx", part(1)).withColumn("total", part(2)).withColumn("slice", F.regexp_extract(F.col(data_col), r"(?s)^[^|]*\|(.*)$", 1))
    return out.where(F.col("idx").isNotNull() & F.col("total").isNotNull())


def _latest(chunks: DataFrame) -> DataFrame:
    """(archive_id, idx, last, low, high): of repeated indices the chunk read last, by partial aggregation; and the totals that they name."""
    read = F.struct("read_order", "slice", "total")
    return chunk_parse(chunks).groupBy("archive_id", "idx").agg(F.max(read).alias("last"), F.min("total").alias("low"), F.max("total").alias("high"))


def _with_status(archives: DataFrame, compat: bool) -> DataFrame:
    status = F.when(F.col("n_chunks") >= F.col("total"), "complete").when(F.col("n_chunks") >= 0.7 * F.col("total"), "partial").otherwise("failed")
    good = F.col("status").isin("complete", "partial") if compat else F.col("status") == "complete"
    return archives.withColumn("status", status).withColumn("_good", good)


def archive_status(chunks: DataFrame, compat: bool = False) -> DataFrame:
    """(archive_id, status, n_chunks, total, totals_agree) from chunks(archive_id, read_order, payload), by partial aggregation: no row holds an archive.

    The last chunk's total counts. Chunks numbered beyond it don't (compat: they do). Under 70 % of the chunks: failed; under all: partial.
    """
    return _status(chunks, compat).select("archive_id", "status", "n_chunks", "total", "totals_agree")


def _status(chunks: DataFrame, compat: bool) -> DataFrame:
    rows = _latest(chunks).select("archive_id", "idx", "last.read_order", "last.total", "low", "high")
    totals = rows.groupBy("archive_id").agg(F.max(F.struct("read_order", "total")).alias("_end"), (F.min("low") == F.max("high")).alias("totals_agree"))
    inside = F.lit(True) if compat else (F.col("idx") >= 0) & (F.col("idx") < F.col("total"))
    held = rows.select("archive_id", "idx").join(totals.select("archive_id", F.col("_end.total").alias("total")), "archive_id").where(inside).groupBy("archive_id").agg(F.count("*").alias("n_chunks"))
    out = totals.select("archive_id", "totals_agree", F.col("_end.total").alias("total")).join(held, "archive_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))
    return _with_status(out, compat)


#: Signs of base64 in a segment (a multiple of four), and chunks whose lengths are summed up together.
SEGMENT, RUN = 4 * 2**20, 4096


def reassemble_segments(chunks: DataFrame, segment: int = SEGMENT, compat: bool = False) -> DataFrame:
    """(archive_id, offset, data): the bytes of archives in segments of segment / 4 * 3 bytes, so that an archive may be of any size.

    As in `reassemble`, only complete archives are decoded (compat: partial ones too, as they are). Chunks meet in runs of RUN. A slice's place is the sum of the lengths before it,
    in its run and of the runs before; slices are cut at the segments' borders, and each segment is joined and decoded alone. Slices are shuffled once, those of
    archives of several runs again to join segments that reach over runs.
    A segment that is no base64 has null data.
    """
    if segment % 4:
        raise ValueError("a segment is a multiple of four signs")
    run = F.coalesce(F.floor(F.col("idx") / RUN), F.lit(0).cast("long")).alias("_run")
    moved = chunk_parse(chunks).where(F.col("archive_id").isNotNull()).select("archive_id", run, "idx", "read_order", "slice", "total")
    moved = moved.repartition("archive_id", "_run")  # the one shuffle of slices; no use of `last` filters what comes before it, so that all read the same files
    last = moved.groupBy("archive_id", "_run", "idx").agg(F.max(F.struct("read_order", "slice", "total")).alias("last"), F.max("idx").alias("_i"))
    last = last.select("archive_id", "_run", F.col("_i").alias("idx"), F.col("last.slice").alias("slice"), F.col("last.read_order").alias("read_order"), F.col("last.total").alias("last_total"))
    runs = last.groupBy("archive_id", "_run").agg(F.max(F.struct("read_order", "last_total")).alias("_end"), F.collect_list(F.struct("idx", F.length("slice").cast("long").alias("n"))).alias("_sizes"))
    archive = Window.partitionBy("archive_id")
    runs = runs.withColumn("total", F.max("_end").over(archive)["last_total"])
    kept = F.col("_sizes") if compat else F.filter("_sizes", lambda x: (x["idx"] >= 0) & (x["idx"] < F.col("total")))
    runs = runs.withColumn("_sizes", kept).select("archive_id", "_run", "total", F.size("_sizes").cast("long").alias("_n"), F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("_all"))
    runs = runs.withColumns({"n_chunks": F.sum("_n").over(archive), "_begin": F.sum("_all").over(archive.orderBy("_run")) - F.col("_all"), "_runs": F.sum((F.col("_n") > 0).cast("int")).over(archive)})
    good = _with_status(runs, compat).where(F.col("_good") & (F.col("_n") > 0)).select("archive_id", "_run", "total", "_begin", "_runs")

    def parts(of: DataFrame) -> DataFrame:
        """(archive_id, segment, begin, part): what each run holds of each segment."""
        rows = last.select("archive_id", "_run", "idx", "slice").join(of, ["archive_id", "_run"])
        rows = rows if compat else rows.where((F.col("idx") >= 0) & (F.col("idx") < F.col("total")))
        n = F.length("slice").cast("long")
        inside = F.sum(n).over(Window.partitionBy("archive_id", "_run").orderBy("idx")) - n
        placed = rows.withColumn("at", F.col("_begin") + inside).where(F.length("slice") > 0)
        numbers = F.sequence(F.floor(F.col("at") / segment), F.floor((F.col("at") + F.length("slice") - 1) / segment))
        cut = placed.select("archive_id", "_run", "at", "slice", F.explode(numbers).alias("segment"))
        begin = F.greatest(F.col("segment") * segment, F.col("at"))
        end = F.least((F.col("segment") + 1) * segment, F.col("at") + F.length("slice"))
        cut = cut.select("archive_id", "_run", "segment", begin.alias("begin"), F.substring(F.col("slice"), (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
        return joined(cut.groupBy("archive_id", "_run", "segment"))

    def joined(groups) -> DataFrame:
        return groups.agg(F.min("begin").alias("begin"), F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("_p")).withColumn("part", F.array_join(F.transform("_p", lambda p: p["part"]), "")).drop("_p")

    whole = parts(good.where("_runs = 1")).select("archive_id", "segment", "part")
    several = joined(parts(good.where("_runs > 1")).groupBy("archive_id", "segment")).select("archive_id", "segment", "part")
    return whole.unionByName(several).select("archive_id", (F.col("segment") * (segment // 4 * 3)).alias("offset"), F.try_to_binary("part", F.lit("base64")).alias("data"))


def reassemble(chunks: DataFrame, compat: bool = False) -> DataFrame:
    """(archive_id, status, n_chunks, total, totals_agree, data) from chunks(archive_id, read_order, payload).

    Status as in archive_status. Only complete archives are decoded (compat: partial ones too, as they are). An archive's chunks meet in one row, so it
    is bounded by a row's 2 GB; reassemble_segments isn't.
    """
    parts = _latest(chunks).groupBy("archive_id").agg(
        F.max(F.struct("last.read_order", "last.total")).alias("_end"), (F.min("low") == F.max("high")).alias("totals_agree"), F.array_sort(F.collect_list(F.struct("idx", F.col("last.slice").alias("slice")))).alias("_p")
    ).withColumn("total", F.col("_end.total"))
    if not compat:
        parts = parts.withColumn("_p", F.filter("_p", lambda p: (p["idx"] >= 0) & (p["idx"] < F.col("total"))))
    out = _with_status(parts.withColumn("n_chunks", F.size("_p").cast("long")), compat)
    text = F.array_join(F.transform("_p", lambda p: p["slice"]), "")
    return out.select("archive_id", "status", "n_chunks", "total", "totals_agree", F.when(F.col("_good"), F.try_to_binary(text, F.lit("base64"))).alias("data"))


def backup_plan(archives: DataFrame, data_col: str = "data", chunk: int = CHUNK, redundancy: float = 0.3) -> DataFrame:
    """(archive_id, n_codes, n_redundant, n_pages) of each archive."""
    codes = F.ceil(F.length(_encoded(data_col)) / chunk).cast("long")
    rows = archives.select("archive_id", codes.alias("n_codes"))
    return rows.select("archive_id", "n_codes", F.ceil(F.col("n_codes") * redundancy).cast("long").alias("n_redundant"), F.ceil(F.col("n_codes") / PER_PAGE).cast("long").alias("n_pages"))
