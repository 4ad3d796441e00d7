"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import discard, durable


def _largest(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(node).agg(F.min("other").alias("least"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> node, component: the smallest node that edges reach. Nodes without an edge are absent.

    Self-loops and repeated edges change nothing. Each round sends every node's neighbours to its smallest one, larger
    neighbours first, then smaller ones; the number of rounds grows with the logarithm of the longest path. Only counts
    and checksums reach the driver.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links, before = durable(links, "links"), None
    for _ in range(rounds):
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        both = both.unionByName(links.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = _largest(both, "node").select("node", F.least("node", "least").alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        large = large.unionByName(least.where("least < node").select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct()
        large = durable(large.where("hi <> lo"), "large")
        down = _largest(large.select(F.col("hi").alias("node"), F.col("lo").alias("other")), "node")
        small = large.withColumnRenamed("hi", "node").join(down, "node")
        small = small.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
        small = small.unionByName(down.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct()
        last, links = links, durable(small, "small")
        discard(last, large)
        mark = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31)))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
