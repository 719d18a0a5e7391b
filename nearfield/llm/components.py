"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialise


def _joined(edges: DataFrame, both: bool) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours v."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; a component is named by its smallest node.

    Alternates two steps: hang each node's larger neighbours below its smallest
    one, then its smaller neighbours, until every edge points at a component's
    smallest node.  The smallest neighbour is a grouped minimum, so a node with
    very many links is summed up before the shuffle, and the joins that follow
    are ones whose large partitions Spark splits.  Self links and NULLs are left out.
    """
    name = "components"
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))
    )
    edges, before = materialise(edges.distinct(), name), None
    while True:
        # Larger neighbours of each node go below the smallest one around it.
        large = _joined(edges, True).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # Then each node and its smaller neighbours go below the smallest of them.
        small = _joined(large, False)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = materialise(small.filter(F.col("u") != F.col("v")).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
