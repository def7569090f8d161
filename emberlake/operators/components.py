"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.operators import grid
from emberlake.session import materialised


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # A component's root ends up next to every member, hence the salted join.
    return (
        grid.spread_join(near.where(F.col("v") > F.col("u")), low, ["u"], F.col("v"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them. Edges point downwards."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    side = grid.spread_join(edges, low, ["u"], F.col("v")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return (
        side.unionByName(low.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _mark(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    ).first()


def components(edges: DataFrame, write_halves: bool = False) -> DataFrame:
    """(node, label) for every node with an edge; the label is the component's smallest node.

    ``edges(u, v)`` is undirected. Minima are aggregates, so a node with very many neighbours is
    combined before its shuffle; no neighbour list is ever gathered. The number of rounds grows
    with the logarithm of the component size, and each round's edges are written out. With ``write_halves`` its first half is
    written too, which pays where edges are too many to be broadcast: the second half reads them three times.
    """
    down = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    current = materialised(down, "edges")
    mark = _mark(current)
    while True:
        half = _large_star(current)
        nxt = materialised(_small_star(materialised(half, "half") if write_halves else half), "edges")
        nxt_mark = _mark(nxt)
        if nxt_mark == mark:
            break
        current, mark = nxt, nxt_mark
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
