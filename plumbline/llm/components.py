"""Connected components of an edge table, as DataFrame rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node that can be reached.

    Labels are pointers to smaller nodes. Each round a node takes the smallest label that its neighbours' labels point
    to, hands it to the node that it pointed to so far (so whole trees move at once), and skips one pointer. Measured on
    paths of 200 to 200,000 nodes, in order, shuffled or folded, this takes about log2(n) + 2 rounds. Only whether
    anything changed reaches the driver. Null nodes are ignored; no edges give no rows; repeated and reversed edges and
    loops change nothing.
    """
    both = edges.where("a is not null and b is not null")
    both = durable(both.select("a", "b").union(both.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        jumped = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("grand")), "label").select("node", "label", "grand")
        near = both.join(jumped.select(F.col("node").alias("a"), "grand"), "a").groupBy(F.col("b").alias("node")).agg(F.min("grand").alias("other"))
        met = jumped.join(near, "node", "left").select("node", "label", F.least("label", "grand", "other").alias("next"))
        handed = met.groupBy(F.col("label").alias("node")).agg(F.min("next").alias("handed"))
        new = durable(met.join(handed, "node", "left").select("node", "label", F.least("next", "handed").alias("next")))
        changed = new.where("next < label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
