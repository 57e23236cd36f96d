"""Connected components of a link table by contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardframe.sources.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """Nodes with the smallest node they can reach: (node, root).

    ``links`` has two columns a and b, in either order. Every round points each node at its
    smallest neighbour, follows the pointers twice, and contracts the graph onto the nodes
    pointed at; a round at least halves the nodes left in every component, and pointers only go
    to smaller nodes, so the last one standing is the smallest. Each round is a table in the
    shared folder. Nodes without links are not listed; nulls and self-links are ignored. Without
    any link the result is empty.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b").distinct(), "edges")
    roots = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("up"))
        # a node whose own pointer leads elsewhere hands that pointer on
        up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = materialize(parent.join(up, "up").select("node", F.col("top").alias("up")), "parents")
        if roots is None:
            roots = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), F.col("up").alias("next"))
            roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        at = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        bt = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = materialize(
            edges.join(at, "a").join(bt, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return materialize(roots, "components")
        roots = materialize(roots, "roots")
