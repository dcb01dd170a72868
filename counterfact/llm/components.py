"""Connected components of a table of links, in rounds of joins.

Every round is a large-star and a small-star step: each node sends its least neighbour to the others, so
that links become stars around the least node of their component. The number of rounds grows with the
logarithm of the component's size. Rounds are written tables, so an executor that is lost costs the tasks it
held and not the rounds before. A node with very many links is a join key like any other: its links are
reduced to one least neighbour before they move, and the join against these is split by the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from counterfact.llm.staging import stage


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Greater neighbours of a node are linked to its least neighbour, or to itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u")
    return (
        joined.where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Lesser neighbours of a node, and the node, are linked to its least neighbour."""
    joined = edges.join(_least(edges), "u")
    moved = joined.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> Row:
    """Count and sum of hashes; the same for the same set of links."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame, a: str, b: str, label: str = "links") -> DataFrame:
    """Rows (node, component) for every node with a link; the component is its least node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = stage(edges, f"{label}-0")
    seen = _digest(edges)
    for turn in range(1, 200):
        if not seen["n"]:
            break
        edges = stage(_small_star(_large_star(edges)), f"{label}-{turn}")
        now = _digest(edges)
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
