"""Connected components of an edge list, by rounds of joins in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtables.llm.stored import saved


def _to_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link each node's neighbours (larger ones, or smaller ones and itself) to its least neighbour."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(turned) if both_ways else edges
    least = around.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("least")
    )
    linked = around.join(least, F.col("a") == F.col("node"))
    if both_ways:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()
    kept = linked.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return kept.unionByName(own).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges `a`, `b` (bigint): the root is the least node that can be reached.

    Alternating star rounds: each node sends its larger neighbours to its least one, then its smaller ones. The number
    of edges never grows, hot nodes are reduced before the shuffle or joined with skew handling, and each round is
    written, so lineage stays short. Ends when a round changes nothing.
    """
    pair = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(edges.filter("a != b").select(*pair).distinct(), "edges")
    state = None
    while True:
        check = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(check) == state or check[0] == 0:
            break
        state = tuple(check)
        # all pairs have a > b, so the smaller neighbours of a are its b
        edges = saved(_to_least(_to_least(edges, True), False), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
