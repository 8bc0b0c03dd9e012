"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.runtime import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Links are contracted round by round. A node goes to the neighbour that comes first in the
    round's order, unless it does itself, and on to where that one goes; links whose ends have met
    are dropped, the others stand between the new ends. Every other round orders nodes by number,
    which settles stars at once, the others by a hash that changes, so that the nodes of a long path
    shrink by a part of them and rounds follow the logarithm. Each round's tables lie in the shared
    folder and go with the next. Null ends aren't links; an empty table has no nodes.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    turn = 0
    while not edges.isEmpty():

        def rank(node: Column) -> Column:
            order = F.xxhash64(F.lit(turn), node) if turn % 2 else F.lit(0).cast("long")
            return F.struct(order.alias("order"), node.alias("node"))

        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("near"))
        step = materialize(step.select(F.col("a").alias("at"), F.least(rank(F.col("a")), F.col("near"))["node"].alias("to")), "steps")
        jump = materialize(step.join(step.select(F.col("at").alias("via"), F.col("to").alias("far")), F.col("to") == F.col("via")).select("at", F.col("far").alias("to")), "jumps")
        moved = edges.join(jump.select(F.col("at").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        moved = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        named = materialize(labels.join(jump, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        discard(edges, labels, step, jump)
        edges, labels, turn = moved, named, turn + 1
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    out = materialize(labels.join(least, "root").select("node", F.col("least").alias("root")), "labels")
    discard(edges, labels)
    return out
