"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.storage import written


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node that links reach.

    Each round sends every node to the smallest of its neighbours that is smaller than itself, twice over, and contracts the
    links: those inside a merged node go, so later rounds join ever fewer rows. The rounds needed grow with the
    logarithm of a chain's length. Null ends are ignored; self links and repeated links do no harm; no links give no rows.
    """
    clean = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    clean = written(clean, "links")
    labels = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct().select("node", F.col("node").alias("root"))
    labels = written(labels, "labels")
    edges = written(clean.union(clean.select("b", "a")).where("a <> b").distinct(), "both-ways")
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels
        up = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = written(up.join(above, "up").select("node", F.col("top").alias("to")), "parents")
        labels = labels.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "labels")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = written(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "both-ways")
    raise RuntimeError(f"links need more than {max_rounds} rounds")
