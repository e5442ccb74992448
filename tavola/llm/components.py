"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.shared import dropped, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges(u, v); a component is named by
    its smallest node.

    Large-star hangs a node's larger neighbours on its smallest neighbour,
    small-star its smaller neighbours and itself; repeated until the edges stay
    as they are, when every component is a star.  Nodes with many neighbours
    are never gathered: minima are aggregated before the shuffle and joined
    back.  Each round is written to the shared folder.
    """
    e = written(_canonical(edges.select("u", "v")), name)
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = _canonical(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v"))
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u > v
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        last, e = e, written(_canonical(small), name)
        dropped(last)
    leaf = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return leaf.union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _canonical(e: DataFrame) -> DataFrame:
    return e.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
