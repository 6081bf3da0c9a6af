"""Connected components of an undirected edge table by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylattice.llm.common import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of all ends of `edges` (a long, b long).

    Every round hooks each node to its smallest neighbour, shortens the hooks to their roots, and contracts the edges;
    a component at least halves each time. Loops and repeated edges do no harm. Every step is a table in the
    shared folder. A node's hook is a partial minimum, so a node with very many edges is no hot key there; joins on
    it are left to adaptive skew handling.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        hooks = materialise(edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p")).withColumn("moved", F.lit(True)), "hooks")
        moved = True
        while moved:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(hooks.select("u", "p").join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "hooks")
            release(hooks)
            hooks, moved = jumped, not jumped.where("moved").isEmpty()
        roots = hooks.select("u", "p")
        shorter = materialise(labels.join(roots, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        one = edges.join(roots, F.col("a") == F.col("u"), "left").select(F.coalesce("p", "a").alias("a"), "b")
        both = one.join(roots, F.col("b") == F.col("u"), "left").select("a", F.coalesce("p", "b").alias("b"))
        fewer = materialise(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(hooks, labels, edges)
        labels, edges = shorter, fewer
    release(edges)
    return labels
