"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize, release


def _pulled(edges: DataFrame, key: str, other: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Edges with `least`, the smallest of `key` and all its partners; and the stored minima.

    The minimum is combined before the shuffle, and the join back is a plain join of two
    stored tables, so that a hub with a third of all edges is split like any skewed join.
    """
    least = materialize(edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("least")), label)
    return edges.join(least, key), least


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges(u, v)` of one ordered type -> `(node, root)`, root the smallest node reachable.

    Only nodes of edges between different, non-null ends have rows. An empty table gives an
    empty table. Rounds grow with the logarithm of the longest path, not with its length;
    every round is written to the shared folder, the one before it is removed.
    """
    current = materialize(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    if current.isEmpty():
        return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    before = None
    while True:
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pulled, least = _pulled(both, "u", "v", "large")
        large = materialize(pulled.where("v > u").select(F.col("least").alias("u"), "v").distinct(), "edges")
        release(least)
        # Small star: smaller neighbours of a node, and the node, move to the smallest of them.
        pulled, least = _pulled(large, "v", "u", "small")
        moved = pulled.select(F.col("least").alias("u"), F.col("u").alias("v")).unionByName(
            least.select(F.col("least").alias("u"), "v")
        )
        small = materialize(moved.where("u <> v").distinct(), "edges")
        release(least)
        release(large)
        release(current)
        state = small.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == before:
            return small.select(F.col("v").alias("node"), F.col("u").alias("root"))
        current, before = small, state
