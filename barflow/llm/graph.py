"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow import session


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge. `edges` has columns a and b.

    Each round every node joins its smallest neighbour, then that one's, and the graph shrinks to the nodes reached; the
    number of rounds grows with the logarithm of the graph's diameter. Rounds are written, so lost executors cost a round
    at most. Edges of a node with very many links are aggregated before they are shuffled.
    """
    step = edges.select("a", "b").filter("a != b").distinct()
    total = None
    while True:
        step = session.settle(step, "edges")
        if step.isEmpty():
            break
        both = step.select("a", "b").unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        near = session.settle(near, "near")
        jump = near.select(F.col("a").alias("to"), F.col("to").alias("next"))
        moved = session.settle(near.join(jump.hint("merge"), "to").select(F.col("a").alias("node"), F.col("next").alias("component")), "moved")
        left = moved.select(F.col("node").alias("a"), F.col("component").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("component").alias("y"))
        if total is None:
            total = moved
        else:
            after = moved.select(F.col("node").alias("component"), F.col("component").alias("next"))
            total = session.settle(
                total.join(after.hint("merge"), "component", "left").select("node", F.coalesce("next", "component").alias("component")),
                "components",
            )
        step = (
            step.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if total is None:
        total = step.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total
