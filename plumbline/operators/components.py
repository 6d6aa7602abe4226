"""Connected components: of an edge table, and of the occupied cells of a grid with sums over each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import durable, rounds


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every row of nodes (node): the smallest node that edges (a, b) lead to, in either direction.

    Each round looks at the roots of a node's neighbours, hangs the node's own root below the smallest of them, and lets
    every node point to its root's root; a path of n nodes takes about log2(n) + 2 rounds. Nodes are any type that Spark
    can order. Null nodes and edges of unknown nodes are ignored; repeated edges and loops change nothing.
    """
    with rounds(nodes.sparkSession) as keep:
        return durable(_joined_up(nodes, edges, keep))


def _joined_up(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    known = keep(nodes.select("node").where("node is not null").distinct())
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    roots = keep(known.withColumn("root", F.col("node")))
    while True:
        above = keep(roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", "root", "top"))
        around = both.join(above.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("seen"))
        lower = keep(above.join(around, "node", "left").select("node", "root", F.least("root", "top", "seen").alias("new")))
        hung = lower.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("hung"))
        after = keep(lower.join(hung, "node", "left").select("node", F.col("root").alias("was"), F.least("new", "hung").alias("root")))
        roots = after.select("node", "root")
        if after.where("was <> root").limit(1).count() == 0:
            return roots


def cell_components(points: DataFrame, size: float, weight: Column, x: str = "x", y: str = "y") -> DataFrame:
    """One row per component of occupied cells: cx, cy (its first cell), cells, points, weight, and the cells' bounds.

    Cells of `size` hold at least one point; cells that touch, also at a corner, are one component. Points without
    coordinates are in no cell; null weights count as zero. Points are summed by cell first, so that a crowded cell is one
    row from then on, and the sums of cells by component partially before they are shuffled.
    """
    place = lambda c: F.floor(F.col(c).cast("double") / size).cast("long")
    usable = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    cells = durable(usable.groupBy(place(x).alias("cx"), place(y).alias("cy")).agg(F.count(F.lit(1)).alias("points"), F.sum(F.coalesce(weight, F.lit(0))).alias("weight")))
    node = F.struct("cx", "cy")
    steps = [(1, 0), (0, 1), (1, 1), (1, -1)]  # the others are the same edges from the other end
    near = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in steps]))
    edges = cells.select(node.alias("a"), near.alias("b")).join(cells.select(node.alias("b")), "b").select("a", "b")
    found = components(cells.select(node.alias("node")), edges)
    named = cells.withColumn("node", node).join(found, "node")
    bounds = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("cx", "cy")]
    summed = named.groupBy("root").agg(F.count(F.lit(1)).alias("cells"), F.sum("points").alias("points"), F.sum("weight").alias("weight"), *bounds)
    return summed.select("root.cx", "root.cy", "cells", "points", "weight", "min_cx", "min_cy", "max_cx", "max_cy")
