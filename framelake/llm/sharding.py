"""Balanced label propagation: linked documents move together under capacity quotas. Only DataFrame functions.

Documents are linked to those with an equal text. Members of a group that stand in one shard are alike,
so labels propagate over a table (group, shard, members) that joins and sums shrink before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.storage import written

#: Ranking buckets on either of two levels; ranks are sums over buckets, never one sorted partition.
BUCKETS = 200
#: Most classes that a target's requests of one gain are dealt into.
MOST_DRAWS = 4096


def ranked(rows: DataFrame, part: Column, first: Column, second: Column, order: list[str]) -> DataFrame:
    """rows with `place`: 0, 1, ... within each value of `part`, in no order but that of scattered buckets.

    Rows go into BUCKETS x BUCKETS buckets of each part by two hashes. A bucket is numbered in a
    window of its own; sums over buckets, then over their first level, give where its numbers begin.
    """
    at = rows.withColumn("_p", part).withColumn("_a", F.pmod(first, F.lit(BUCKETS))).withColumn("_b", F.pmod(F.shiftright(second, 20), F.lit(BUCKETS)))
    counts = at.groupBy("_p", "_a", "_b").agg(F.count("*").alias("n"))
    inner = counts.withColumn("low", F.sum("n").over(Window.partitionBy("_p", "_a").orderBy("_b")) - F.col("n"))
    outer = counts.groupBy("_p", "_a").agg(F.sum("n").alias("m"))
    outer = outer.withColumn("high", F.sum("m").over(Window.partitionBy("_p").orderBy("_a")) - F.col("m"))
    begins = inner.join(outer, ["_p", "_a"]).select("_p", "_a", "_b", (F.col("low") + F.col("high")).alias("begin"))
    number = F.row_number().over(Window.partitionBy("_p", "_a", "_b").orderBy(*order)) - 1
    return at.withColumn("_n", number).join(begins, ["_p", "_a", "_b"]).withColumn("place", (F.col("_n") + F.col("begin")).cast("long")).drop("_p", "_a", "_b", "_n", "begin")


def propagated(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """state(grp, start, shard, n) after label propagation: `start` stays, `shard` moves.

    In each round every group names the shard with most of its members among those with room for the rest
    (else among all); members elsewhere ask to move there, as one block for each shard they stand in.
    Requests of equal size between two shards in opposite directions are exchanged, which needs no room.
    Others are admitted by gain (the neighbours that a move brings together; groups that no shard can
    hold come last), as far as the target has room: sums over (target, gain, draw) classes tell which
    classes fit; one too large for the room left doesn't hold up others. Draws are new in each round, as
    many as requests ask for. A move joins two blocks of a group, so rounds end; they do after two in a
    row that admit nothing.
    """
    number, idle = 0, 0
    while idle < 2:
        number += 1
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = lambda shard: F.element_at(F.array(*[F.lit(capacity - load.get(s, 0)) for s in range(shards)]), shard + 1)
        tally = state.groupBy("grp", "shard").agg(F.sum("n").alias("c"))
        tally = tally.withColumn("all", F.sum("c").over(Window.partitionBy("grp")))  # a row for each shard at most
        fits = room(F.col("shard")) >= F.col("all") - F.col("c")
        choice = F.struct(fits.alias("fits"), "c", F.xxhash64("grp", "shard", F.lit(number)).alias("draw"), "shard")
        best = tally.groupBy("grp").agg(F.max(choice).alias("top")).select("grp", F.col("top.shard").alias("to"), F.col("top.c").alias("there"))
        moves = tally.join(best, "grp").where(F.col("shard") != F.col("to"))
        gain = F.when(F.col("all") > capacity, -1).otherwise(F.floor(F.log2("there")).cast("int"))
        moves = written(moves.select("grp", "shard", "to", "c", gain.alias("gain"), F.xxhash64("grp", "shard", F.lit(number)).alias("draw")), "moves")
        requests = moves.count()
        if not requests:
            break
        ways = moves.groupBy("shard", "to", "c").agg(F.count("*").alias("there"))
        back = ways.select(F.col("shard").alias("to"), F.col("to").alias("shard"), "c", F.col("there").alias("back"))
        lanes = ways.join(back, ["shard", "to", "c"]).select("shard", "to", "c", F.least("there", "back").alias("swaps"))
        placed = ranked(moves.join(lanes, ["shard", "to", "c"]), F.struct("shard", "to", "c"), F.col("draw"), F.col("draw"), ["grp"])
        swapped = written(placed.where(F.col("place") < F.col("swaps")).select("grp", "shard", "to"), "swapped")
        draws = min(MOST_DRAWS, max(16, requests))
        others = moves.join(swapped.select("grp", "shard"), ["grp", "shard"], "left_anti").withColumn("draw", F.pmod("draw", F.lit(draws)))
        classes = others.groupBy("to", "gain", "draw").agg(F.sum("c").alias("n")).where(F.col("n") <= room(F.col("to")))
        filled = F.sum("n").over(Window.partitionBy("to").orderBy(F.desc("gain"), "draw"))
        admitted = classes.withColumn("filled", filled).where(F.col("filled") <= room(F.col("to"))).select("to", "gain", "draw")
        going = written(others.join(admitted, ["to", "gain", "draw"]).select("grp", "shard", "to").unionByName(swapped), "admitted")
        if going.isEmpty():
            idle += 1
            continue
        idle = 0
        state = written(state.join(going, ["grp", "shard"], "left").select("grp", "start", F.coalesce("to", "shard").alias("shard"), "n"), "state")
    return state


def balanced_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of documents.

    Law `rows`: the shards' counts are at most one apart, slots are gapless from 0. Equal texts share a
    shard unless their group has no room in one. Null texts count as empty ones: size 1, checksum 0.
    Repeated rows are copies like others; ties and null doc_ids are no matter; an empty table gives an
    empty result. A group too large for a shard stays spread evenly.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("grp"))
    # a row's salt is drawn once and written, so that rows equal in all columns part too
    rows = rows.withColumn("salt", F.xxhash64(F.col("doc_id").cast("string"), "grp", F.rand(11)))
    rows = written(rows.withColumn("start", F.pmod("salt", F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    state = rows.groupBy("grp", "start").agg(F.count("*").alias("n"))
    state = written(state, "state")
    groups = state.groupBy("grp").agg(F.sum("n").alias("all")).where("all > 1").select("grp")
    state = written(state.join(groups, "grp").select("grp", "start", F.col("start").alias("shard"), "n"), "state")
    moved = propagated(state, shards, total // shards)
    placed = written(rows.join(moved.select("grp", "start", "shard"), ["grp", "start"], "left"), "placed")
    # groups keep their shard up to its quota; what is over, and single texts, fill the room that is left
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    # a group stays in one first-level bucket, its members part in the second: few groups are cut at the quota, none is one task's
    grouped = written(ranked(placed.where("shard is not null"), F.col("shard"), F.xxhash64("grp"), F.col("salt"), ["grp", "salt"]), "grouped")
    stay = grouped.where(F.col("place") < limit)
    columns = ["doc_id", "size", "text_crc32", "salt"]
    loose = placed.where("shard is null").select(*columns, "grp").unionByName(grouped.where(F.col("place") >= limit).select(*columns, "grp"))
    held = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, run = [], 0
    for s in range(shards):
        run += quota[s] - held.get(s, 0)
        ends.append(run)
    pool = ranked(loose, F.lit(0), F.col("salt"), F.xxhash64("salt"), ["salt"])
    shard = sum(((F.col("place") >= e).cast("int") for e in ends[:-1]), F.lit(0))
    begin = F.element_at(F.array(*[F.lit(e - (quota[s] - held.get(s, 0))) for s, e in enumerate(ends)]), F.col("shard") + 1)
    base = F.element_at(F.array(*[F.lit(held.get(s, 0)) for s in range(shards)]), F.col("shard") + 1)
    filled = pool.withColumn("shard", shard).withColumn("slot", F.col("place") - begin + base)
    whole = stay.select(*columns, "shard", F.col("place").alias("slot")).unionByName(filled.select(*columns, "shard", "slot"))
    return whole.select(*columns[:3], F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
