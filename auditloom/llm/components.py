"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.persisting import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Links may repeat, point either way and join a node to itself. Minima are combined per task before
    the shuffle and written before they are joined, so that a node with very many links is split.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v"))
    edges = materialize(ends.distinct(), "edges")
    seen = _print_of(edges)
    while True:
        large = materialize(_large_star(edges), "large-star")
        edges = materialize(_small_star(large), "small-star")
        found = _print_of(edges)
        if found == seen:
            break
        seen = found
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = materialize(both.groupBy("u").agg(F.min("v").alias("low")), "lowest")
    met = both.filter(F.col("v") > F.col("u")).join(lowest, "u")
    return met.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    lowest = materialize(edges.groupBy("u").agg(F.min("v").alias("low")), "lowest")
    moved = edges.join(lowest, "u").filter(F.col("v") > F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()
