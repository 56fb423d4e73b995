"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.skew import join_unique
from lotwise.staging import Staging


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node passes its least neighbour to its greater neighbours."""
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS node", "least(u, m) AS m")
    return join_unique(both.where("v > u"), F.col("u"), least, "node").selectExpr("v AS u", "m AS v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours point at the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS node", "m")
    moved = join_unique(edges, F.col("u"), least, "node").where("v > m").selectExpr("v AS u", "m AS v")
    return moved.unionByName(least.selectExpr("node AS u", "m AS v")).distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()


def connected_components(links: DataFrame, staging: Staging) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the least node it reaches.

    Nodes are integers; rows with a null end or equal ends say nothing. Hubs do
    not gather: least neighbours combine on the map side, and the joins meet one
    row per node. Each round is written, so lineage stays short.
    """
    edges = links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    edges = staging.table(edges, "edges")
    before, now = None, _digest(edges)
    while now != before:
        edges = staging.table(_small_star(_large_star(edges)), "edges")
        before, now = now, _digest(edges)
    nodes = edges.selectExpr("u AS id", "v AS component")
    return nodes.unionByName(edges.selectExpr("v AS id", "v AS component").distinct())
