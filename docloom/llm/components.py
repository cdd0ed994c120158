"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import with_checkpoints


def _measure(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum: equal before and after a round when nothing changed."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    n, total = edges.agg(F.count("*"), digest).first()
    return n, int(total or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for every node with an edge.

    edges: a, b (bigint, not null); repeated rows, both directions and loops may occur.
    Large-star and small-star rounds alternate until the edges are stars; their number
    follows the logarithm of the nodes. A node's neighbours are never gathered: each
    round takes minima (summed before the shuffle) and joins them back, where Spark may
    split a hot node. Rounds end in a checkpoint, so lost executors cost one round.
    """
    with_checkpoints(edges.sparkSession)
    ordered = edges.filter(F.col("a") != F.col("b"))
    stars = ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = _measure(stars)
    while before[0]:
        stars = _small_star(_large_star(stars)).checkpoint()
        after = _measure(stars)
        if after == before:
            break
        before = after
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
