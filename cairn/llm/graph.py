"""Connected components by alternating star contraction; nothing but two numbers an iteration reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, stash


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, label): the smallest node of each component, for nodes with an edge.

    Large-star then small-star per round: the edge count never grows beyond its start and the number of rounds is
    logarithmic in the component's diameter. Each round is cut off by a table in the shared folder, and so is the result,
    which can be discarded. No edges: no rows.
    """
    edges = stash(edges.where("a <> b").select("a", "b").distinct())
    state = _state(edges)
    while state[0]:
        near = _both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stash(large)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        used, edges = edges, stash(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(used, large)
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    labels = stash(stars.union(stars.select(F.col("label").alias("node"), "label").distinct()))
    discard(edges)
    return labels
