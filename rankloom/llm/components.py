"""Connected components of a graph of links, by rounds of joins on narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``links`` (columns ``a``, ``b``).

    Alternating large-star and small-star steps: every node's larger (then smaller) neighbours
    are tied to the least node known to it.  The number of edges never grows, a hub's edges
    are combined before the shuffle, and the rounds grow with the logarithm of the longest path.
    Nothing is collected; each round is written to the shared folder.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # large star: larger neighbours go to the least of the node and its neighbours
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.distinct()
        # small star: smaller neighbours, and the node, go to the least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
