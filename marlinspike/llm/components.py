"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import BROADCAST_ROWS, ONE_TASK, Scratch, in_one_task, join_counted


def connected_components(edges: DataFrame, scratch: Scratch, key: str = "cc") -> DataFrame:
    """Smallest node of each node's component.

    ``edges`` has the columns a, b (long).  Returns (node, component) for each
    node of an edge that is not its own component; a node that is missing is
    the smallest of its component or has no edge.  An empty input gives an
    empty result; repeated edges and self-loops change nothing.

    Every step works on key-wise minima, aggregated before they are shuffled;
    the minimum of a hub then goes to its edges, which stay where they are: all
    minima are broadcast while their number allows it, later those of hubs.  No
    neighbour list is gathered anywhere.  A graph of few edges, counted first,
    takes one task a step.  The steps end once every component is a star: each
    node has one edge, and that leads to a node with none to a smaller one.
    """

    def with_low(rows: DataFrame, low: DataFrame, key: str, total: int) -> DataFrame:
        if 2 * edges <= ONE_TASK:  # both sides are one partition
            return rows.join(low.drop("n").hint("merge"), key)
        # of two numbers a node, and no more nodes than twice the edges
        return rows.join(F.broadcast(low.drop("n")), key) if total <= BROADCAST_ROWS else join_counted(rows, low, [key], "n", total)

    spark = scratch.spark
    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{key}-0"
    )
    step, edges = 0, current.count()
    while edges:  # no step adds to their number
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = in_one_task(both, 2 * edges)
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_low(both.where("v > u"), low, "u", 2 * edges).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = in_one_task(scratch.write(large, f"{key}-large-{step}"), 2 * edges)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_low(large, low, "a", edges).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        step += 1
        small = in_one_task(small.unionByName(low.select("a", F.col("m").alias("b"))), 2 * edges)
        current = scratch.write(small.where("a <> b").distinct(), f"{key}-{step}")
        scratch.drop(f"{key}-{step - 1}", f"{key}-large-{step - 1}")
        ends = current.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionByName(current.select(F.col("b").alias("u"), F.lit(0).alias("up")))
        ends = in_one_task(ends, 2 * edges).groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        edges, open_ = ends.agg(F.sum("ups"), F.count_if(F.expr("ups > 1 or ups = 1 and least = 0"))).first()
        if not open_:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
