"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from journalsieve.workspace import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hang_on_minimum(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Re-hang neighbours of each node on the smallest node around it.

    ``keep_larger`` moves the larger neighbours (large star), otherwise the smaller ones and the
    node itself (small star).  The minimum is a pre-aggregated ``min``; a hot centre node is split
    by the skew handling of the join.
    """
    arcs = _both_ways(edges)
    if not keep_larger:
        arcs = arcs.filter("b < a")
    lowest = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    hung = arcs.join(lowest, "a")
    moved = hung.filter("b > a") if keep_larger else hung
    result = moved.select(F.col("b").alias("a"), F.col("root").alias("b"))
    if not keep_larger:
        result = result.union(lowest.select("a", F.col("root").alias("b")))
    return result.filter("a != b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.bit_xor(F.xxhash64("a", "b")).alias("x")).head()
    return (row.n, row.x)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component = least node.

    The rounds grow with the logarithm of the longest chain.  Each round is written, so the
    lineage stays short and a lost executor costs one round at most.
    """
    current = settle(edges.select("a", "b").filter("a != b").distinct(), "edges")
    seen = _fingerprint(current)
    while True:
        current = settle(
            _hang_on_minimum(_hang_on_minimum(current, keep_larger=True), keep_larger=False),
            "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)
