"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest neighbour.

    Edges lead from ``u`` to a smaller ``v``.  Only smaller neighbours can be the
    smallest, so each edge is counted at its larger end and moved at its smaller one.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, move to the smallest neighbour.

    That one comes from an aggregation and is joined back, so that no
    neighbourhood is gathered in one place.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none to a smaller one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0))).limit(1).count() == 0


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    Alternating large and small stars, which end in about log(n) rounds.  Each
    round is a table in the shared folder, so lineage stays short and a lost
    executor costs one round.  No edges give no rows.
    """
    now = written(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )
    while not _settled(now):
        now = written(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
