"""Temperature mixing of sources: a bisected exponent, then budgeted block permutations. Only DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.storage import written

#: Blocks that a source's documents are dealt into; a pass draws whole blocks in a permuted order.
BLOCKS = 512
#: Bits of a draw (of 60) below its step; a block has 512 steps.
STEP_BITS = 51
#: Parts that each step of the search for the exponent cuts its interval into.
PARTS = 16
#: Rows of the plan (sources times blocks, under 100 bytes each) up to which it is sent to every task.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Runs of signs other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_number(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of the parts, null ones left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, steps: int = 5) -> float:
    """The largest exponent in 0 to 1 that meets the targets, for sources(tokens > 0).

    target_entropy: least entropy of the weights, as a share of its maximum. max_repeats: most passes over
    any source when the budget gives every source one. Flatter weights have more of both, so each step
    bisects, in PARTS at once: one small aggregation a step, whatever the number of sources. With the
    repetition limit the smallest exponent within it counts; an entropy it forbids is not reached.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["t"] or total["n"] < 2:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total["t"])))

    def search(good) -> float:
        """Smallest exponent from which on `good` holds (it holds for 1)."""
        low, high = 0.0, 1.0
        for _ in range(steps):
            tries = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
            rows = sources.select(share.alias("lp"), F.explode(F.array(*[F.lit(a) for a in tries])).alias("a"))
            weight = F.exp(F.col("a") * F.col("lp"))
            found = rows.groupBy("a").agg(F.sum(weight).alias("z"), F.sum(weight * F.col("lp")).alias("d"), F.max((F.col("a") - 1) * F.col("lp")).alias("up"), F.max((1 - F.col("a")) * F.col("lp")).alias("down"))
            ok = sorted(r["a"] for r in found.collect() if good(r))
            first = ok[0] if ok else 1.0
            low, high = max(low, first - (high - low) / PARTS), first
            if first == tries[0]:
                break
        return high

    passes = lambda r: r["up"] + r["down"] <= math.log(max_repeats) + 1e-12
    entropy = lambda r: math.log(r["z"]) - r["a"] * r["d"] / r["z"]
    limit = search(passes) if max_repeats is not None else 0.0
    if target_entropy is None:
        return limit
    wanted = target_entropy * math.log(total["n"])
    # entropy falls as the exponent grows: the least exponent at which it is under the target, or 1
    return max(limit, search(lambda r: r["a"] >= 1.0 or entropy(r) < wanted))


def mixed(docs: DataFrame, keep: list[str], source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", *, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(row, tokens, weight, exponent, n_copies, first_block) for every row; row holds the kept columns.

    Source weights are token shares to the power of the exponent, normalised. Budget: the given tokens, or
    the least at which every source is passed once, so no document is lost. A source's part of the budget
    is as many whole passes as fit, then blocks of documents in a permuted order (a hash of seed, source
    and block), then documents of the next block in the order of a hash, as far as tokens last. n_copies
    is how often a row is drawn; first_block the place of its block in the permutation.

    Null sources are one source of their own; null texts have no tokens and are drawn with their blocks;
    repeated rows are drawn alike; an empty table gives an empty result.
    """
    key = F.coalesce(F.col(source_col), F.lit("\0"))
    draw = draw_number(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    whole = docs.select(F.struct(*keep).alias("row"), key.alias("src"), word_count(F.col(text_col)).alias("tokens"), draw.alias("draw"))
    whole = whole.withColumn("block", F.pmod("draw", F.lit(BLOCKS)))
    rows = written(whole.select("src", "block", "draw", "tokens"), "mix-rows")
    blocks = written(rows.groupBy("src", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = written(blocks.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    some = sources.where("tokens > 0")
    exponent = find_exponent(some, target_entropy, max_repeats)
    total = float(some.agg(F.sum("tokens")).first()[0] or 1)
    power = F.pow(F.col("tokens") / total, F.lit(exponent))
    norm = some.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("least")).first()
    z = norm["z"] or 1.0
    budget = float(budget_tokens) if budget_tokens is not None else (norm["least"] or 0.0) * z
    weight = F.when(F.col("tokens") > 0, power / z).otherwise(F.lit(0.0))
    quota = F.round(F.lit(budget) * F.col("weight")).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1))
    passes = F.greatest(passes, F.lit(1)) if budget_tokens is None else passes
    plan = sources.withColumn("weight", weight).withColumn("quota", quota).withColumn("passes", passes.cast("long"))
    plan = plan.withColumn("left", F.greatest(F.col("quota") - F.col("passes") * F.col("tokens"), F.lit(0)))
    order = draw_number(F.lit(seed), F.col("src"), F.col("block"))
    w = Window.partitionBy("src").orderBy(order, "block")
    run = blocks.withColumn("place", F.row_number().over(w) - 1).withColumn("upto", F.sum("tokens").over(w))
    run = run.withColumnRenamed("tokens", "block_tokens").join(plan, "src")
    run = run.withColumn("rest", F.col("left") - (F.col("upto") - F.col("block_tokens")))
    run = written(run.select("src", "block", "place", "weight", "passes", "block_tokens", "rest"), "mix-plan")
    # the block that the budget ends in, then the step of draws in it: only the documents of that step are ranked
    cut = run.where("rest > 0 and rest < block_tokens").select("src", "block", "rest")
    inside = rows.join(cut, ["src", "block"]).withColumn("step", F.shiftright("draw", STEP_BITS))
    steps = inside.groupBy("src", "block", "step", "rest").agg(F.sum("tokens").alias("tokens"), F.max("draw").alias("last"))
    steps = steps.withColumn("upto", F.sum("tokens").over(Window.partitionBy("src", "block").orderBy("step")))
    whole_steps = steps.where("upto <= rest").groupBy("src", "block").agg(F.max("last").alias("last"))
    broken = steps.where("upto > rest and upto - tokens <= rest").select("src", "block", "step", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left_over"))
    inside = inside.join(broken, ["src", "block", "step"]).groupBy("src", "block", "step", "draw", "left_over").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("src", "block", "step").orderBy("draw"))
    last = inside.withColumn("upto", upto).where("upto <= left_over").groupBy("src", "block").agg(F.max("draw").alias("last"))
    last = last.unionByName(whole_steps).groupBy("src", "block").agg(F.max("last").alias("last"))
    plan = run.join(last, ["src", "block"], "left")
    full = (F.col("rest") >= F.col("block_tokens")) & (F.col("rest") > 0)
    part = F.coalesce(F.col("draw") <= F.col("last"), F.lit(False))
    plan = written(plan, "mix-draws")
    small = plan.count() <= BROADCAST_ROWS
    drawn = whole.join(F.broadcast(plan) if small else plan, ["src", "block"])
    return drawn.select("row", "tokens", "weight", F.lit(exponent).alias("exponent"), (F.col("passes") + (full | part).cast("long")).alias("n_copies"), F.col("place").cast("int").alias("first_block"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, weight, exponent, n_copies, first_block) for every row of documents."""
    out = mixed(docs, ["doc_id", "source"])
    return out.select("row.doc_id", "row.source", "tokens", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"), "n_copies", F.col("first_block").cast("long").alias("first_block"))
