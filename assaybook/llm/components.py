"""Connected components of a graph held as a table of edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _state(edges: DataFrame) -> tuple:
    """A count and two order-free sums that change when the edges do."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it can reach.

    Each large step hangs a node's larger neighbours on its smallest one, each small step its
    smaller ones; the number of rounds grows with the logarithm of the graph. All steps are
    aggregates that combine before their shuffle, and joins that Spark can split where one node
    has very many neighbours. Edges from a node to itself only say that the node is there.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    nodes = now
    now = now.filter("a <> b")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.*").filter("a <> b").distinct(), name)
        new = _state(now)
        if new == state:
            break
        state = new
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    everyone = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
    return everyone.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
