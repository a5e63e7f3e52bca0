"""Connected components of an undirected graph given as an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.session import materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the smallest node around it.  Both keep
    the components, and they end in stars around each component's smallest node
    after a logarithmic number of rounds.  Minima are pre-aggregated, so a node
    with very many neighbours is no hot key there; the join back may be dealt anew
    by Spark where it is skewed.  An error is raised if ``MAX_ROUNDS`` are not enough.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every edge now leads from a larger node u to a smaller node v.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = materialise(large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == (state["n"], state["x"]):
            break
        before = (state["n"], state["x"])
    else:
        raise RuntimeError(f"components have not converged in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
