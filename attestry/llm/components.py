"""Connected components by alternating large-star and small-star, for graphs of any size.

Both steps are a grouped minimum (partial results before the shuffle) and a join on the node, whose
hot keys Spark splits. Each round's edges are cut from their lineage in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of node and neighbours. In and out: u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. In and out: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    inner = edges.join(low, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return inner.union(low.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame, per_part: int = 100_000) -> DataFrame:
    """(node, component) for every node of the links ``(u, v)``; the component is its smallest node.

    Self links and repeated links are allowed; links with a null end are ignored.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    state = F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    edges = cut_lineage(edges)
    before = edges.agg(*state).first()
    while before["n"]:
        parts = 1 + before["n"] // per_part  # few edges are not spread over many files
        edges = cut_lineage(_small_star(_large_star(edges.coalesce(parts))).coalesce(parts))
        after = edges.agg(*state).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
