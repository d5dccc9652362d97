"""Connected components as alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.plans.storage import materialize, scratch


def connected_components(edges: DataFrame, group: list[str] | None = None, max_rounds: int = 100) -> DataFrame:
    """``edges(group..., a, b)`` -> ``(group..., node, component)`` with component = least node reachable.

    Self loops stand for nodes of their own. Each star is one partial aggregation and one join, so a hub's
    rows stay spread over tasks until an adaptive skew split; each round ends in a written table, and the
    result is one. Rounds needed grow with the logarithm of the longest path; ``max_rounds`` only guards against endless loops.
    """
    with scratch() as keep:
        return keep(_stars(edges, list(group or []), max_rounds))


def _stars(edges: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    base = materialize(
        edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null").distinct()
    )
    nodes = base.select(*keys, F.col("a").alias("node")).union(base.select(*keys, F.col("b").alias("node"))).distinct()
    links = base.where("a < b")
    # the least neighbours are a table of their own, which leaves a hub's join to adaptive splitting
    for _ in range(max_rounds):
        # done when all links are stars: a node has one parent, and no parent has one itself
        most = links.groupBy(*keys, "b").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 1) == 1 and links.join(links.select(*keys, F.col("a").alias("b")), [*keys, "b"], "left_semi").isEmpty():
            break
        # large-star: every larger neighbour of a node points at the node's least neighbour
        both = links.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(*keys, F.col("b"), F.col("a")))
        least = materialize(both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = materialize(both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        # small-star: a node and its smaller neighbours point at the least of them
        least = materialize(large.groupBy(*keys, "b").agg(F.min("a").alias("m")))
        joined = large.join(least, [*keys, "b"])
        small = joined.where("a <> m").select(*keys, F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(*keys, F.col("m").alias("a"), "b"))
        links = materialize(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(*keys, F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.join(roots, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
