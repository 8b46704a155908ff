"""Connected components of an edge table by repeated hooking and contraction.

Each round hooks every node to its smallest neighbour, shortens the resulting trees by
pointer jumping and replaces edges by edges between roots, so the number of nodes that
still have an edge at least halves.  All aggregates combine on the map side and all joins
are plain equi-joins, which adaptive execution splits when a key is hot; nothing is
collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _hook(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    return both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root"))


def _jump(parents: DataFrame) -> DataFrame:
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = parents.join(up, "root").select(
            "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")
        )
        moved = materialize(moved, "cc-jump")
        parents = moved.select("node", "root")
        if not moved.filter("moved").limit(1).count():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any integer type to ``(node, component)``.

    ``component`` is the smallest node reachable.  Nodes without an edge are absent;
    loops and repeated edges are ignored; no edges give an empty result.
    """
    edges = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialize(edges, "cc-edges")
    labels = None
    while edges.limit(1).count():
        parents = _jump(materialize(_hook(edges), "cc-hook"))
        if labels is None:
            labels = parents.withColumnRenamed("root", "component")
        else:
            up = parents.select(F.col("node").alias("component"), "root")
            labels = labels.join(up, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            )
            labels = materialize(labels, "cc-labels")
        pu = parents.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        pv = parents.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = edges.join(pu, "u").join(pv, "v").filter("ru <> rv")
        edges = materialize(
            edges.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges"
        )
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
