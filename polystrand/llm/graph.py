"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread, staged


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): nodes have the same root if and only if a
    path joins them. Nodes without an edge do not appear; an empty table gives no row.

    In each round every node goes to the neighbour (or itself) with the least random
    rank, each of these to its own choice, and edges are renamed; what is left within
    one name goes. The number of nodes shrinks by a constant factor a round, whatever the
    shape. Nothing but a row count reaches the driver, and each round ends in a written
    table."""
    both = edges.select("a", "b").where("a <> b")
    edges = staged(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    names, turn = None, 0
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        nearest = edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
        choice = staged(nearest.select("a", F.least("m", rank("a"))["n"].alias("to")), "choice")
        onward = choice.select(F.col("a").alias("to"), F.col("to").alias("root"))
        step = staged(choice.join(spread(onward), "to").select(F.col("a").alias("node"), "root"), "step")
        if names is None:
            renamed = staged(step, "names")
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
            renamed = staged(names.join(spread(later), "root", "left").select("node", F.coalesce("later", "root").alias("root")), "names")
            discard(names)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        fewer = edges.join(spread(left), "a").join(spread(right), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        fewer = staged(fewer, "edges")
        discard(edges, choice, step)
        edges, names, turn = fewer, renamed, turn + 1
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
