"""Connected components by randomised contraction.

Each round every node points to the neighbour, or itself, that comes first in an order drawn anew, and edges are
carried over to the nodes pointed to. An expected constant share of the nodes goes each round, whatever the shape of
the graph, so the rounds grow with the logarithm of its size. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame | None:
    """node and root of each node of an edge (bigints); the root is a node of the same component. None if there is no edge.

    Loops, repeated and reversed edges change nothing; edges with a null end are left out.
    """
    edges = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        order = lambda node, turn=turn: F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("to"))
        ends = edges.select(F.col("a").alias("node"), order("b").alias("o")).unionAll(edges.select(F.col("b").alias("node"), order("a").alias("o")))
        step = ends.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", order("node"))["to"].alias("to"))
        step = written(step, "step")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = written(roots, "roots")
        turn += 1
    return roots
