"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it is connected to.

    Each round hooks the tree of a node below the smallest root among its neighbours' and then
    lets every node point to its root's root, so trees of any shape flatten as they merge: the
    rounds grow with the logarithm of the nodes. Labels are written once a round. A node with very
    many edges shrinks to one row per task before the rows of its neighbours meet.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.distinct(), "edges")
    loops = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    labels = materialize(loops.distinct().select("node", F.col("node").alias("root")), "labels")
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        # Edges go on between the roots of their ends; those within one tree are done.
        pairs = materialize(
            pairs.join(of_a, "a")
            .join(of_b, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
        if pairs.isEmpty():
            return labels
        hooked = pairs.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))
        hooks = _flattened(materialize(hooked, "hooks"))
        labels = materialize(
            labels.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels"
        )


def _flattened(hooks: DataFrame) -> DataFrame:
    """``hooks`` (root, to) with every ``to`` replaced by the end of its chain, by pointer doubling."""
    while True:
        onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("_next"))
        # Chains go to smaller nodes, so they end.
        longer = hooks.join(onward, "to", "left").select("root", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved"))
        longer = materialize(longer, "hooks")
        if longer.where("_moved").isEmpty():
            return longer.select("root", "to")
        hooks = longer.select("root", "to")
