"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import discard, written


def _closer(edges: DataFrame) -> DataFrame:
    """One round; each edge a < b gives one edge at most.

    m(x): the least neighbour of x below it; p(x): m(x), or x if it has none. The edge to
    m(b) becomes (p(m(b)), b), any other one joins p(a) and m(b). Every x stays connected
    with m(x), since m(x) is with p(m(x)) in its turn, and so all that was connected.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    up = least.select(F.col("b").alias("a"), F.col("m").alias("p"))
    told = edges.join(least, "b").join(up, "a", "left").withColumn("p", F.coalesce("p", "a"))
    tree = F.col("a") == F.col("m")
    told = told.select(
        F.when(tree, F.col("p")).otherwise(F.least("p", "m")).alias("a"),
        F.when(tree, F.col("b")).otherwise(F.greatest("p", "m")).alias("b"),
    )
    return told.where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the (different) edges are stars: each node below one edge, or above some."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.lit(1).alias("below")), F.struct(F.col("a").alias("x"), F.lit(0).alias("below")))).alias("e"))
    nodes = ends.select("e.*").groupBy("x").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return nodes.where("below > 1 or (below > 0 and least = 0)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of the edges that isn't the smallest of its component, and that smallest.

    ``edges`` has long columns a and b; rows with a null end are left out. Each round
    writes its edges to the shared folder; the rounds end when the edges are stars.
    """
    down = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    state = written(down.distinct(), "edges")
    while not _settled(state):
        old, state = state, written(_closer(state), "edges")
        discard(old)
    return state.select(F.col("b").alias("a"), F.col("a").alias("b"))
