"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, write_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs; the root is the component's least
    node.  Each round hangs a node's greater neighbours, then its lesser ones, on the least node
    seen; it ends when the edges are stars.  Rounds grow with the logarithm of the longest path.
    Minima are aggregated before the shuffle, and joins on a hot node can be split."""
    now = write_cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b", "b").distinct())
        seen = (state["n"], state["h"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))  # v < u on every edge here
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last, now = now, write_cut(small.where("a <> b").distinct(), "stars")
        release(last)
