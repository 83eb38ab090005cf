"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Connect each vertex's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not small:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # least neighbours are aggregated before they are dealt by vertex: a hub costs each task one row; its edges meet its
    # least neighbour in a join, which broadcasts a small side and splits a hub's partition in a large one
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every vertex that has an edge (u, v); a component is its least vertex.

    The edge set ends as stars around the least vertices; a step's edges are written to the shared
    folder, so that neither lineage nor driver holds them. Self-loops are ignored, an empty table gives none.
    """
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct().select(F.col("v").alias("u"), F.col("u").alias("v")), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now.n == 0 or now == state:
            break
        state = now
        before, edges = edges, materialize(_star(_star(edges, small=False), small=True), "edges")
        discard(before)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
