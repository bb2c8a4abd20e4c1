"""Connected components over an edge table, by alternating large-star and small-star steps.

Each round is a few joins and aggregations; hot nodes are combined map-side, and every round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most. Nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, each once. Large: neighbours above a node go to the least node near it; small: those below do."""
    if large:
        seen = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = seen.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(work: Work, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node it is linked with) for each node with an edge, itself apart (roots have no row).

    edges: a, b of one sortable type. Loops and repeats are ignored; no edges give no rows.
    """
    now = work.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = now.agg(F.count("*"), sign).first()
    for k in range(1, rounds):
        if not before[0]:
            break
        now = work.save(_star(_star(now, large=True), large=False), f"edges-{k}")
        work.drop(f"edges-{k - 1}")
        after = now.agg(F.count("*"), sign).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
